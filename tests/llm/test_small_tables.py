"""What small tables cost, where Spark is told not to join small partitions by itself."""

import random
import uuid

import pytest

from ledgerline.llm.components import connected_components
from ledgerline.llm.toxicity import labelled_sample
from tests.llm.test_toxicity import LABELS, corpus

PARTITIONS = 60


@pytest.fixture
def fixed_partitions(spark):
    conf = {"spark.sql.shuffle.partitions": str(PARTITIONS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def tasks_of(spark, work):
    """What `work` returns, and how many tasks it ran."""
    context, group = spark.sparkContext, uuid.uuid4().hex
    context.setJobGroup(group, group)
    try:
        found = work()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {i for job in tracker.getJobIdsForGroup(group) for i in tracker.getJobInfo(job).stageIds}
    return found, sum(s.numCompletedTasks for s in map(tracker.getStageInfo, stages) if s)


def test_rounds_over_a_small_graph_are_few_tasks(spark, fixed_partitions):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 200)]
    random.Random(1).shuffle(edges)
    found, tasks = tasks_of(spark, lambda: connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {(r["node"], r["component"]) for r in found} == {(i, 1) for i in range(1, 41)} | {(i, 100) for i in range(100, 300)}
    # Two steps before the rounds have a task for each partition: the distinct edges and their count.
    assert 0 < tasks < 4 * PARTITIONS


@pytest.mark.parametrize("in_a_task", [1, 50])
def test_graphs_of_many_tasks(spark, monkeypatch, in_a_task):
    monkeypatch.setattr("ledgerline.llm.components.TASK_EDGES", in_a_task)
    edges = [(i, i + 1) for i in range(1, 40)] + [(100 + i, 400) for i in range(200)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long").selectExpr("cast(a as decimal(20,0)) a", "cast(b as decimal(20,0)) b"))
    assert {(int(r["node"]), int(r["component"])) for r in found.collect()} == {(i, 1) for i in range(1, 41)} | {(i, 100) for i in (*range(100, 300), 400)}


def test_a_sample_is_read_again_without_a_shuffle(spark, make_docs, fixed_partitions):
    rows, labels = corpus()
    sample = labelled_sample(make_docs(rows), spark.createDataFrame(labels, LABELS), 2048)
    found, tasks = tasks_of(spark, lambda: sample.select("text", "calibrates").collect())
    assert len({r["text"] for r in found}) == len(found) > 600
    # Two of texts, and one of the numbers that are broadcast.
    assert 0 < tasks <= 3
