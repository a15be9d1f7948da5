"""Trusted ids as bitmaps choose the same documents as a join, near or far apart."""

import pytest

from notarium.llm import quality_rules


@pytest.mark.parametrize("most", [1 << 14, 0])
def test_bitmaps_and_join_choose_the_same(spark, monkeypatch, most):
    monkeypatch.setattr(quality_rules, "MOST_RANGES", most)
    ids = [*range(-70, 70), 32767, 32768, 32769, -32768, -32767, -32769, 65536, 10**12, -(10**12), 2**62, -(2**62), None]
    docs = spark.createDataFrame([(i, f"word{i} other") for i in ids * 2], "doc_id long, text string").repartition(3)
    trusted = spark.createDataFrame([(i,) for n, i in enumerate(ids) if n % 3 and i is not None], "doc_id long")
    got = quality_rules.trusted_grams(docs, trusted)
    want = docs.join(trusted, "doc_id", "left_semi").select(
        quality_rules._buckets(quality_rules.words_of(docs.text)).alias("grams"), quality_rules.fold_of(docs.text).alias("fold"))
    as_rows = lambda df: sorted((r.grams, r.fold) for r in df.collect())
    assert as_rows(got) == as_rows(want) and got.count() == 2 * trusted.count()
    assert quality_rules.trusted_grams(docs, trusted.limit(0)).count() == 0
