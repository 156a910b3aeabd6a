"""The whole pipeline against plain versions of its five stages, and the quality rules with live cutoffs against their SQL."""

import base64
import re

import check_oracle
import corpus_pipeline
import public_tokenizers
import tiktoken
from llm.test_documents import brute_fingerprint, brute_measures, prose

from claimscope.llm.risk_rules import ORACLE_SQL, fit_cutoffs, op8_risk_rules

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, fp string"
MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def plain_run(documents, items):
    """``documents``: id to (text, lang, source); symbols are junk by the labels, an item in a text is a leak."""
    kept = {}
    for i, (text, lang, source) in documents.items():
        n_words, *_, n_repeat = brute_measures(text)
        if n_words >= 50 and 100 * n_repeat <= 50 * n_words and (text or "").count("#") == 0:
            kept[i] = (text, lang, source)
    prints = {i: brute_fingerprint(t) for i, (t, *_) in kept.items()}
    first = {i: i for i in kept}

    def root(i):
        while first[i] != i:
            i = first[i]
        return i

    ids = sorted(kept)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                low, high = sorted((root(a), root(b)))
                first[high] = low
    kept = {i: v for i, v in kept.items() if root(i) == i}
    kept = {i: v for i, v in kept.items() if not any(item in v[0] for item in items)}
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return {i: (lang, source, encoding.encode_ordinary(MAIL.sub("[EMAIL]", text))) for i, (text, lang, source) in kept.items()}


def tables(spark, folder, documents, labels, items):
    rows = [(i, t, lang, source, len(t or ""), "clash") for i, t, lang, source in documents]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_run_equals_the_plain_stages(spark, tmp_path):
    item = prose(5000, 40)
    clean = [(i, prose(i, 60), "en", "web") for i in range(700)]
    odd = [
        (800, None, "en", "web"), (801, "", "en", None), (802, "too short", None, "web"), (803, "the cat sat " * 40, "en", "web"),
        *[(810 + i, prose(900 + i, 60) + " ###" * 60, "en", "web") for i in range(20)],
        (840, prose(3, 60), "en", "copy"), (841, prose(3, 60).upper(), "en", "copy"), (842, prose(3, 60), None, None),
        (850, f"{prose(950, 30)} {item} {prose(951, 30)}", "en", "leak"), (851, item + " " + prose(952, 20), "en", "leak"),
        (860, prose(960, 60) + " mail to jo.doe@example.org now", "en", "web"), (861, "me@x.co " + prose(961, 60), None, "web"),
        (870, prose(970, 30_000), "en", "long"),
    ]
    documents = clean + odd
    labels = [(i, 1, 0) for i in range(700)] + [(810 + i, 0, 0) for i in range(20)] + [(None, 1, 0), (3, None, None), (9999, 1, 0)]
    folder = tables(spark, tmp_path / "t", [*documents, clean[5], clean[5]], labels, [(1, item), (2, None), (3, "")])
    result = corpus_pipeline.run(spark, folder)
    assert result.columns == ["doc_id", "lang", "source", "ids"]
    found = result.collect()
    wanted = plain_run({i: v for i, *v in documents}, [item])
    assert len(found) == len(wanted) and 690 < len(wanted) < 710
    assert {r.doc_id: (r.lang, r.source, list(r.ids)) for r in found} == wanted
    assert {3, 860, 861, 870} <= wanted.keys() and not {840, 841, 842, 850, 851} & wanted.keys()


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    folder = tables(spark, tmp_path / "empty", [], [], [])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).schema.simpleString() == docs.schema.simpleString()
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_quality_rules_with_live_cutoffs_equal_their_sql(spark):
    """The small tables have too few labels for a cutoff; here several strata have some."""
    folder = "/root/testdata/sf0.1"
    tables = [spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels")]
    live = [r for r in fit_cutoffs(*tables).collect() if any(c is not None for c in r.cutoffs)]
    assert len(live) >= 2
    assert check_oracle.differences(op8_risk_rules(spark, folder), check_oracle.connect(folder), ORACLE_SQL) == []
