"""Plan checks of the documents in the tables."""

import __spark_entry__ as E
from lapse.sources.tables import read_table
from tests.conftest import SF_SMALL


def test_every_turn_and_every_event_is_judged(spark):
    rows = E.queries()["plan_checks_documents"](spark, SF_SMALL).collect()
    turns = read_table(spark, SF_SMALL, "conversations").where("role = 'user'").select("conv_id", "turn").collect()
    events = read_table(spark, SF_SMALL, "events").select("event_id").collect()
    want = [f"conv-{r.conv_id}-{r.turn}" for r in turns] + [f"event-{r.event_id}" for r in events]
    assert sorted(r.plan_id for r in rows) == sorted(want)
    routed = E.queries()["route_user_questions"](spark, SF_SMALL).collect()
    charts = {f"conv-{r.conv_id}-{r.turn}": r.operation not in ("get_dataset_info", "predict_hypothetical", "predict_customer_risk")
              for r in routed}
    for r in rows:
        if r.plan_id in charts:
            assert r.passed and r.n_steps == 1 + charts[r.plan_id] and r.n_steps_without_params == 0
