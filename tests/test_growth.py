"""What a task or worker holds does not grow with the input."""

from gridleaf.operators import spatial
from gridleaf.plans import queries as q


def found_plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_drawn_pages_are_dealt_by_their_number(spark, sf, monkeypatch):
    whole = {r["page"] for r in q.ruled_pages(spark, sf).select("page").collect()}
    monkeypatch.setattr(q, "PAGES_A_TASK", 1)
    found = q.ruled_pages(spark, sf).select("page")
    assert found.rdd.getNumPartitions() == max(4, len(whole)) and {r["page"] for r in found.collect()} == whole


def test_boxes_that_lie_alike_are_looked_up_once(spark):
    """A thousand boxes in one place ask for its words once, and each of them gets the words."""
    box = "named_struct('x_min', 0D, 'y_min', 0D, 'x_max', 9D, 'y_max', 9D) bbox"
    boxes = spark.range(1000).selectExpr("1 page", "id", box)
    words = spark.range(50).selectExpr("1 page", "50 - id ord", "string(id) text", box)
    found = spatial.box_contents(boxes, words, ["page"]).collect()
    text = "".join(f"{i}\n" for i in range(49, -1, -1))
    assert [(r["n"], r["value"], len(r["blobs"])) for r in found] == [(50, text, 50)]
    filled = spatial.fill_cells(boxes, words, ["page"]).collect()
    assert len(filled) == 1000 and {(r["value"], len(r["blobs"])) for r in filled} == {(text, 50)}
    shown = found_plan(spatial.box_contents(boxes, words, ["page"]).select("page", "value"))
    assert shown.count("collect_list") == 1, "boxes of words are carried though not asked for"
