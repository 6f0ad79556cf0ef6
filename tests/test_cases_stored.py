"""Cases are picked from scored records that are stored: the rules are not evaluated again for the pick."""

from screenlens.plans import q_store as QS


def test_scored_once(spark, sf, monkeypatch):
    kept = []

    def stored(df, name):
        kept.append(df)
        return whole(df, name)

    whole = QS.stored
    monkeypatch.setattr(QS, "stored", stored)
    monkeypatch.setattr(QS, "_STORES", {})
    cases = QS.saved_cases(spark, sf).count()
    assert len(kept) == 1 and kept[0].count() == spark.read.parquet(f"{sf}/orders.parquet").count() > cases > 0
