from folio.plans.pdfs import pdf_pages
from folio.sources.batches import tasks


def test_files_are_read_in_as_many_tasks_as_are_asked_for(spark):
    plan = pdf_pages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert f", {tasks(spark)}), REPARTITION_BY_NUM" in plan
