"""Alerts make sentences for the turn that goes out alone; replayed calls are dealt to many tasks and read once."""

from pyspark.sql import functions as F

from tamiz.operators import records, rules
from tamiz.plans import queries


def test_a_level_takes_no_sentences(spark, sf):
    state = rules.running_state(queries._symptoms(spark, sf))
    plan = state.select(rules.evaluate(state)["level"].alias("level"))._jdf.queryExecution().optimizedPlan().toString()
    assert "umbral de alarma" not in plan and "rojo" in plan
    rows = lambda df: sorted((r.call_id, r.turn, r.level, tuple(r.reasons), r.symptoms, r.pain) for r in df.collect())
    assert rows(records.first_alerts(state, "pain")) == rows(records.alerts(records.evaluated(state), "pain")) != []
    found = records.evaluated(state).select("severity", F.col("reasons")[0].alias("first"))
    assert found.where((F.col("severity") == 0) != F.col("first").startswith("Sin signos")).count() == 0


def test_replayed_calls_are_dealt_to_all_tasks(spark, sf):
    """Neither their few bytes nor a second shuffle puts them in one."""
    made = queries.call_machine(spark, sf)
    used = made.groupBy(F.spark_partition_id().alias("p")).count().count()
    assert used > 1 and "REPARTITION_BY_NUM" in made._jdf.queryExecution().executedPlan().toString()
