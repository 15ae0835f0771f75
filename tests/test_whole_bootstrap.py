"""The registered comparison takes as many replicates as the operator and the command."""

import inspect

from prosegrain.operators import score
from prosegrain.plans import cli, queries


def test_replicates():
    default = inspect.signature(score.delta).parameters["reps"].default
    assert queries.REPS == default == cli.parser().parse_args(["delta", "a", "b", "-l", "x"]).boot == 2000
    assert "rep < 2000" in queries.ORACLE["delta_bootstrap"]
