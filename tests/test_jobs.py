"""The two end-to-end jobs."""

from creditloom.plans import jobs
from creditloom.session import fresh_path


def test_train_then_explain(spark, views):
    tables = {n: getattr(views, n) for n in ("app", "prev", "bureau", "bureau_bal", "pos", "inst", "card")}
    folder = fresh_path(spark, "job")
    result = jobs.train_run(tables, folder, "r", 5, jobs.Options(clusters=5, restarts=1, valid_share=0.4)).first()
    assert 0.0 <= result.auc <= 1.0 and result.log_loss > 0
    found = jobs.explain_run(spark, folder, "r", 5, threshold=0.2)
    assert set(found) == {"tiers", "plane", "top_features", "signed_features", "explanations", "edges"}
    n = result.p + result.n
    assert found["plane"].count() == n and found["explanations"].count() == 5 * n
    assert sum(r.n for r in found["tiers"].collect()) == n
    assert found["top_features"].count() <= 30 and found["signed_features"].count() == 20
    assert 0 < found["edges"].count() <= 1000
