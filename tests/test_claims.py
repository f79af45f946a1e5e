import re
from pathlib import Path

from ragspark.plans import catalogue


def test_ids_not_covered_are_not_claimed():
    readme = (Path(__file__).parent.parent / "README.md").read_text()
    partly = {"P12"}
    missing = set(re.findall(r"\b[A-Z]\d\d\b", readme.split("Not covered of the survey")[1])) - partly
    assert {"S10", "S25", "E11", "M04"} <= missing
    for name, query in catalogue.QUERIES.items():
        assert not missing & set(re.findall(r"\b[A-Z]\d\d\b", query.__doc__ or "")), name
