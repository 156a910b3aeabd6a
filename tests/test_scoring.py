import pytest
from conftest import rows
from pyspark.sql import functions as F

from claimscope import schemas as S
from claimscope.plans.features import feature_matrix
from claimscope.plans.history_store import HistoryStore
from claimscope.plans.scoring import ClaimScorer, assemble
from claimscope.plans.tables import prepared


@pytest.fixture(scope="module")
def fitted(spark, sf_dir):
    history = prepared(spark, sf_dir, "history")
    # Learnable from one feature: is the provider's mean amount above the overall mean?
    overall = history.agg(F.avg("InscClaimAmtReimbursed")).first()[0]
    labels = history.groupBy("Provider").agg(
        (F.avg("InscClaimAmtReimbursed") > overall).cast("int").alias("label")
    )
    return history, labels, ClaimScorer.fit(history, labels, trees=2, depth=2)


def test_every_sample_row_gets_a_label_that_a_reloaded_model_repeats(spark, sf_dir, fitted, tmp_path):
    history, labels, scorer = fitted
    batch = prepared(spark, sf_dir, "batch")
    sample = batch.unionByName(batch.filter("Gender = 1"))
    scored = scorer.score(sample, history)
    assert scored.columns[-1] == S.PREDICTION
    got = rows(scored.select("ClaimID", S.PREDICTION), "ClaimID", S.PREDICTION)
    assert len(got) == sample.count()
    assert {r[1] for r in got} <= {0, 1}
    right = scored.join(labels, "Provider").filter(F.col("label") == F.col(S.PREDICTION))
    assert right.count() > 0.9 * len(got)

    scorer.save(spark, str(tmp_path / "scorer"))
    again = ClaimScorer.load(spark, str(tmp_path / "scorer"))
    assert again == scorer and again.forest.nodes
    repeated = again.score(sample, history).select("ClaimID", S.PREDICTION)
    assert rows(repeated, "ClaimID", S.PREDICTION) == got


def test_the_compiled_trees_equal_the_model(spark, sf_dir, fitted, tmp_path):
    """Labels and margins are those of the fitted model; kept statistics give the same."""
    history, _, scorer = fitted
    batch = prepared(spark, sf_dir, "batch")
    matrix = feature_matrix(batch, history, scorer.levels, per_batch_row=False)
    scored = scorer.model.transform(assemble(scorer.scaler.transform(matrix.frame), matrix.names))
    wanted = {r.ClaimID: (int(r.prediction), r.rawPrediction[1]) for r in scored.select("ClaimID", "prediction", "rawPrediction").collect()}
    store = HistoryStore.create(history, str(tmp_path / "store"))
    for past in (history, store):
        got = {r.ClaimID: r.margin for r in scorer.margins(batch, past).collect()}
        assert got.keys() == wanted.keys()
        for claim, (label, margin) in wanted.items():
            assert (int(got[claim] > 0), got[claim]) == (label, pytest.approx(margin, abs=1e-9))
    assert len(scorer.forest.features()) < 20
    assert len({n[0] for n in scorer.forest.nodes}) == 2
