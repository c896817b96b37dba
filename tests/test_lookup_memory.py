"""The lookup gathers no table that grows in the driver, however small the planner takes it for."""

from passlane.operators import lookup as LK
from passlane.plans.inputs import Inputs
from tests.conftest import SF


def test_requests_and_declarations_are_joined_in_the_executors(spark):
    i = Inputs(spark, SF)
    matches = LK.lookup_matches(i.lookup_requests, i.declarations)  # a few KB: any of its tables is under the bound
    for found in (LK.first_match(matches), LK.previous_declaration_lookup(i.lookup_requests, i.declarations)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan and "BroadcastHashJoin" not in plan
        found.count()  # nor once the sizes are known
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan
