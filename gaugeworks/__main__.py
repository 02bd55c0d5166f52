"""Command line: `spark-submit` target, or `python -m gaugeworks <job> ...`."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from gaugeworks.plans import jobs
from gaugeworks.session import open_session

_JOBS = {
    "build_sensor_profiles": (jobs.build_sensor_profiles, ["input-path", "output-path"]),
    "enrich_with_zone_label": (
        jobs.enrich_with_zone_label,
        ["sensor-profiles-path", "zone-lookup-path", "output-path"],
    ),
}


def parse(argv: Sequence[str] | None = None) -> argparse.Namespace:
    """Every option of a job but --runs-path is required; a bad call ends before a session starts."""
    parser = argparse.ArgumentParser(prog="gaugeworks")
    commands = parser.add_subparsers(dest="job", required=True)
    for name, (_, options) in _JOBS.items():
        command = commands.add_parser(name)
        for option in options:
            command.add_argument(f"--{option}", required=True)
        command.add_argument("--runs-path", help="table that gets a record of the run")
    return parser.parse_args(argv)


def main(argv: Sequence[str] | None = None) -> None:
    options = vars(parse(argv))
    job = options.pop("job")
    spark = open_session(job)
    try:
        _JOBS[job][0](spark, **options)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
