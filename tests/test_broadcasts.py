"""Sides of joins that grow with the input are never gathered in the driver, however small their files look."""

import re

import pytest

import __spark_entry__ as entry
from quillspan.session import ship_package

SMALL = "/root/testdata/sf0.001"
# By name: the least that a plan with this side broadcast would show below the exchange.
GROWING = [
    "missing_proofs", "valid_proofs", "token_confusion", "token_metrics", "token_assignment", "registry_token_recall",
    "gold_realign_nearest", "gold_realign_spaced", "answer_schemas", "expansion_outcomes", "grid_best_config", "character_metrics",
    "candidate_lines", "validation_reasons", "consultation_replay",
]


def broadcasts(plan: str) -> list[str]:
    """What stands below each broadcast exchange of a plan, as one text each."""
    lines, out = plan.split("\n"), []
    depth = lambda line: re.match(r"[ :|]*(?:[+:]- )?", line).end()
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            own = []
            for below in lines[k + 1 :]:
                if depth(below) <= depth(line):
                    break
                own.append(below)
            out.append("\n".join(own))
    return out


@pytest.mark.parametrize("name", GROWING)
def test_no_side_of_studies_is_broadcast(spark, name):
    ship_package(spark)
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    # A table of labels that is aggregated by label or cell is bounded; its last exchange is by these columns.
    bounded = r"Exchange hashpartitioning\((?:label|gold_label|gold_label#\d+, predicted_label|mode)#"
    growing = [b for b in broadcasts(plan) if "FileScan" in b and not re.search(bounded, b.split("FileScan")[0].split("Exchange RoundRobin")[0])]
    assert not growing, growing[0][:2000]
