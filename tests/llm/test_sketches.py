import hashlib
import random
import re

import pytest

from gaugeworks.llm import sketches as S


def pieces(text):
    word = r"[^\x20\x09-\x0D]+[\x20\x09\x0B-\x0D]*"
    cut = re.findall(f"(?:{word}){{1,{S.PIECE_WORDS}}}", text)
    first = re.findall(f"(?:{word}){{1,{S.FIRST_WORDS}}}", cut[0]) if cut else []
    return {p.rstrip(" ") for p in first + cut[1:]}


def dice(a, b):
    return 1.0 if not a and not b else 2 * len(a & b) / (len(a) + len(b))


def brute(rows):
    """Expected rows without the fingerprints; ties of ids are for the caller to avoid."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    distinct = list(dict.fromkeys((i, t or "") for i, t in order))
    out = []
    for own, text in order:
        text = text or ""
        following = distinct[(distinct.index((own, text)) + 1) % len(distinct)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        mine = pieces(text)
        out.append((
            own, len(text), hashlib.sha256(edited.encode()).hexdigest(), dice(mine, pieces(edited)), dice(mine, pieces(following)),
        ))
    return out


def compare(spark, rows):
    got = S.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    have = [(r["id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got]
    assert sorted(map(repr, have)) == sorted(map(repr, brute(rows)))
    return got


def corpus(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lines = [" ".join(f"w{rng.randint(0, 300)}" for _ in range(rng.choice([1, 3, 20, 40, 100]))) for _ in range(rng.randint(0, 12))]
        rows.append((i * 3, "\n".join(lines)))
        if rng.random() < 0.3:
            rows.append((i * 3 + 1, rows[-1][1]))
    return rows


def test_matches_brute_force(spark):
    rows = corpus(1, 150)
    got = {r["id"]: r for r in compare(spark, rows)}
    texts = dict(rows)
    marks = {}
    for i, row in got.items():
        marks.setdefault(texts[i], set()).add(row["fingerprint"])
    assert all(len(m) == 1 for m in marks.values())
    assert len({next(iter(m)) for m in marks.values()}) == len({frozenset(pieces(t)) for t in marks})
    assert all((row["fingerprint"] == row["edited_fingerprint"]) == (row["near_edited"] == 1.0) for row in got.values())


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = S.op8_document_fingerprints(spark, sf)
    assert got.columns == [
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    ]
    have = [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got.collect()]
    assert sorted(map(repr, have)) == sorted(map(repr, brute(rows)))


def test_edge_cases(spark):
    long = "\n".join(f"line {i} of a very long text" for i in range(20_000))
    compare(spark, [(None, "first"), (1, None), (2, ""), (3, long), (9, "x 🙂 y"), (9, "x 🙂 y"), (12, " \n\t ")])
    compare(spark, [(5, "alone in the table")])
    wide = spark.createDataFrame([("a b", 1, "x", 2)], "text string, doc_id long, fingerprint string, k int")
    assert S.fingerprint_documents(wide).count() == 1
    assert S.fingerprint_documents(wide.limit(0)).count() == 0


@pytest.mark.parametrize("width", [1, 40])
def test_peeling_recovers_the_difference_or_says_so(spark, width):
    ours, theirs = list(range(100, 130)), list(range(110, 145))
    pairs = spark.createDataFrame([(7, ours, theirs, width), (8, ours, ours, width)], "g long, ours array<long>, theirs array<long>, width int")
    peeled = {r["g"]: r for r in S.subtract_and_peel(pairs).collect()}
    only = (set(range(100, 110)), set(range(130, 145)))
    assert 8 not in peeled
    if width == 1:
        assert peeled[7]["left"] > 0
    else:
        assert (set(peeled[7]["plus"]), set(peeled[7]["minus"]), peeled[7]["left"]) == (*only, 0)
    # Sketches far too small at first: tried again until every digest is there, once each.
    found = {r["g"]: r for r in S.recovered_digests(pairs.drop("width"), first_width=0.01).collect()}
    assert (set(found[7]["plus"]), set(found[7]["minus"])) == only
    assert len(found[7]["plus"]) == 10 and len(found[7]["minus"]) == 15
    assert found[8]["plus"] == found[8]["minus"] == []
    near = {r["g"]: r["near"] for r in S.likeness(pairs.drop("width"), first_width=0.01).collect()}
    assert near == {7: 2 * 20 / 65, 8: 1.0}


def test_recovered_digests_match_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for g in range(60):
        ours = list({rng.getrandbits(64) - 2**63 for _ in range(rng.choice([0, 1, 5, 400]))})
        theirs = rng.sample(ours, len(ours) * rng.choice([0, 1, 2]) // 2) + [rng.getrandbits(62) for _ in range(rng.choice([0, 1, 300]))]
        rows.append((g, ours, theirs))
    pairs = spark.createDataFrame(rows, "g long, ours array<long>, theirs array<long>")
    got = {r["g"]: (set(r["plus"]), set(r["minus"]), len(r["plus"]) + len(r["minus"])) for r in S.recovered_digests(pairs, first_width=0.01).collect()}
    assert got == {g: (set(a) - set(b), set(b) - set(a), len(set(a) ^ set(b))) for g, a, b in rows}


def test_many_keys_in_a_cell_do_not_overflow(spark):
    """More keys than any packed number would hold: the cells' numbers stay exact."""
    keys = spark.range(4_000_000).agg(S.F.collect_list(S.F.xxhash64("id")).alias("digests"))
    marks = S.base_fingerprints(keys.select(S.F.lit(1).cast("long").alias("g"), "digests"))
    assert len(marks.first()["fingerprint"]) == 32


def test_no_python_on_the_executors(spark):
    plan = S.op8_document_fingerprints(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
