"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base rules are fixed. The learned rules are shares of a text (symbols, capitals, exclamation marks, repeated lines), each with a cutoff per
stratum. Cutoffs come from labelled documents, divided by a hash of their ids. A quarter proposes: for each rule the strictest
cutoff of the grid that refuses an equal part of ``RISK`` of its good documents of a stratum or less, and an order of the rules, those first
that refuse the fewest good documents over the grid. The rest tests all rules together: rule by rule in that order it walks the grid
from lenient to strict up to the proposal, the rules before staying, as long as the exact binomial test rejects "more than ``RISK`` of the
good documents would be refused by any of the rules" at level ``ERROR / strata``. To these documents the sequence is fixed, which
needs no further correction over its steps, and the division is Bonferroni's over strata. So with probability
1 - ``ERROR`` the chosen cutoffs of no stratum together refuse more than ``RISK`` of its good documents.
A stratum with too few labels (fewer than about 490 good ones, at four strata) has no cutoff and refuses nothing by the learned rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimscope.llm.common import let, load, stage, unused_name

RISK, ERROR = 0.01, 0.1
#: Cutoffs from lenient to strict; a value above the cutoff is refused.
GRID = (0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01, 0.005)
RULES = ("symbols", "capitals", "exclamations", "repeated_lines")
#: Rows up to which the table of cutoffs is broadcast; above it is joined by a shuffle.
BROADCAST_STRATA = 10_000
#: Labelled documents up to which their ids are broadcast (16 MB); above it they are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
_SYMBOLS = "[#*$%&|<>]"
_SPACE = r"[\x09-\x0D]"


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def _repeated_words(words: Column) -> Column:
    """Words within three-word windows that are found twice or more; windows are told apart by a 64-bit hash of their words.

    Most texts repeat no window, which a set of their hashes shows. For the others the hashes, their last bits replaced by the position, are
    sorted as plain numbers; the few with an equal neighbour are compared again by the whole hash, and the stretches they cover are summed.
    """
    windows = F.transform(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)),
    )

    def near(h: Column, places: Column) -> Column:
        def alike(s: Column) -> Column:
            heads = lambda x, y: F.coalesce(x.bitwiseOR(places) == y.bitwiseOR(places), F.lit(False))
            kept = F.filter(s, lambda x, j: heads(x, F.get(s, j + 1)) | heads(x, F.get(s, j - 1)))
            return F.transform(kept, lambda x: x.bitwiseAND(places).cast("int"))

        packed = F.transform(h, lambda x, i: x.bitwiseOR(places).bitwiseXOR(places).bitwiseOR(i.cast("long")))
        return let(F.sort_array(packed), alike)

    def twice(s: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        kept = F.filter(s, lambda x, j: same(x, F.get(s, j + 1)) | same(x, F.get(s, j - 1)))
        return F.sort_array(F.transform(kept, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, F.lit(2), F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    def repeated(h: Column) -> Column:
        places = F.pow(F.lit(2.0), F.length(F.bin(F.size(h).cast("long")))).cast("long") - 1
        found = let(places, lambda m: near(h, m))
        pairs = let(found, lambda at: F.sort_array(F.transform(at, lambda i: F.struct(F.get(h, i).alias("h"), i.alias("i")))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(let(pairs, twice), covered)).otherwise(F.lit(0))

    return let(windows, repeated)


def _measures(text: Column) -> dict[str, Column]:
    """The measures of a text: counts of characters, and two structs of its words and of its lines."""
    plain = F.regexp_replace(text, _SPACE, " ")

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            _repeated_words(words).cast("long").alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n"), F.size(F.array_distinct(lines)).cast("long").alias("n_distinct"))

    return {
        "word_chars": F.length(F.replace(plain, F.lit(" "), F.lit(""))).cast("long"),
        "words": let(F.array_remove(F.split(plain, " "), ""), of_words),
        "lines": let(_lines(text), of_lines),
        "symbols": _count(text, _SYMBOLS).cast("long"),
        "capitals": _count(text, "[A-Z]").cast("long"),
        "exclamations": (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long"),
    }


def _measured(docs: DataFrame, text: Column) -> tuple[DataFrame, dict[str, Column]]:
    """``docs`` with the measures in new columns, and these columns by measure."""
    names = {}
    for name, value in _measures(text).items():
        names[name] = unused_name(docs, f"_{name}")
        docs = docs.withColumn(names[name], value)
    return docs, {name: F.col(f"`{column}`") for name, column in names.items()}


def _shares(m: dict[str, Column]) -> list[Column]:
    """The values of the learned rules, in the order of RULES."""
    chars = F.greatest(m["word_chars"], F.lit(1))
    lines = m["lines"]
    return [m[c] / chars for c in RULES[:3]] + [(lines["n"] - lines["n_distinct"]) / F.greatest(lines["n"], F.lit(1))]


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 10."""
    z = n + F.lit(11.0)
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    for k in range(1, 11):
        series = series - F.log(n + F.lit(float(k)))
    return series


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p), by the terms from k down; 1 where k is at least n p."""
    first = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p))
    # Terms fall off at least like a normal tail: beyond 40 deviations they add nothing to a double.
    used = F.least(k, F.ceil(40 * F.sqrt(n * p * (1 - p)) + 60)).cast("int")
    state = F.aggregate(
        F.sequence(F.lit(0), used),
        F.struct(first.alias("term"), F.lit(0.0).alias("sum")),
        lambda s, i: F.struct((s["term"] * (k - i) * (1 - p) / ((n - k + i + 1) * p)).alias("term"), (s["sum"] + s["term"]).alias("sum")),
        lambda s: s["sum"],
    )
    return F.when(k < n * p, F.least(state, F.lit(1.0))).otherwise(F.lit(1.0))


def fit_cutoffs(docs: DataFrame, labels: DataFrame, stratum: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``stratum, cutoffs``: a cutoff or null for each rule, from the documents labelled good (``quality`` 1).

    Rows without id, text or label do not count; an id labelled twice counts once, as good only if no label says otherwise.
    Documents with a null stratum are a stratum of their own. All labelled documents are used.
    """
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    good = stage(good.select("doc_id"), "good")
    rows = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(doc_id).alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), F.col(text).alias("text"))
    few = good.count() <= BROADCAST_LABELS
    if few:
        rows = rows.join(F.broadcast(good), "doc_id", "left_semi")
    rows, m = _measured(rows, F.col("text"))
    # The values are written before they are compared with all cutoffs; beyond few labels only they are shuffled, not texts.
    held = stage(rows.select("doc_id", "stratum", F.array(*_shares(m)).alias("shares")), "shares")
    if not few:
        held = held.join(good, "doc_id", "left_semi")
    held = held.withColumn("proposes", F.expr("substring(md5(CAST(doc_id AS STRING)), 1, 1) < '4'"))
    # Stricter cutoffs refuse no fewer, so the cutoffs of a rule that pass are the first ones.
    rules = []
    for r in range(len(RULES)):
        counts = [f"count_if(proposes AND shares[{r}] > {cut}D)" for cut in GRID]
        n_passing = " + ".join(f"CAST({k} <= {RISK / len(RULES)}D * count_if(proposes) AS INT)" for k in counts)
        rules.append(f"struct({' + '.join(counts)} AS refusals, {r} AS r, {n_passing} AS steps)")
    proposed = stage(held.groupBy("stratum").agg(F.expr(f"sort_array(array({', '.join(rules)})) AS rules")), "proposed")
    n_strata = proposed.count()
    own = proposed.select(F.col("stratum").alias("own"), "rules")
    tested = held.where("NOT proposes").join(F.broadcast(own) if n_strata <= BROADCAST_STRATA else own, F.col("stratum").eqNullSafe(F.col("own")))
    grid = "array(" + ", ".join(f"{cut}D" for cut in GRID) + ")"
    # The step from which on a document is refused: steps of the rules before, and the cutoffs of this one that its value is not above.
    step = f"size(filter({grid}, cut -> cut >= shares[x.r]))"
    first = F.expr(f"array_min(transform(rules, (x, j) -> if({step} < x.steps, {len(GRID)} * j + {step}, NULL)))")
    over = ", ".join(f"count_if(first <= {s})" for s in range(len(RULES) * len(GRID)))
    counts = tested.select("stratum", "rules", first.alias("first")).groupBy("stratum", "rules").agg(F.count("*").cast("double").alias("n"), F.expr(f"array({over})").cast("array<double>").alias("refused"))
    tests = stage(counts, "steps").select("stratum", "rules", "n", F.explode("refused").alias("k"))
    passes = binomial_tail(F.col("n"), F.col("k"), RISK) <= F.lit(ERROR) / max(n_strata, 1)
    walked = tests.groupBy("stratum", "rules").agg(F.sum(passes.cast("int")).cast("int").alias("passed"))
    place = "CAST(array_position(rules.r, r) AS INT) - 1"
    cutoffs = F.expr(f"transform(sequence(0, {len(RULES) - 1}), r -> get({grid}, least(passed - {len(GRID)} * ({place}), rules[{place}].steps) - 1)) AS cutoffs")
    # A stratum all of whose labels propose is tested on none.
    untested = proposed.join(walked.select(F.col("stratum").alias("own")), F.col("stratum").eqNullSafe(F.col("own")), "left_anti").withColumn("passed", F.lit(0))
    return stage(walked.unionByName(untested).select("stratum", cutoffs), "cutoffs")


def judged(docs: DataFrame, cutoffs: DataFrame, stratum: str = "lang", text: str = "text") -> DataFrame:
    """``docs`` with a new last column ``quality_rules``: the base measures, ``base_failed`` and ``kept``.

    A null or empty text has no words and fails the base rules. Repeated rows are judged alike; nothing is shuffled while the table of cutoffs is small.
    """
    if unused_name(docs, "quality_rules") != "quality_rules":
        raise ValueError("there is a column quality_rules already")
    few = cutoffs.count() <= BROADCAST_STRATA
    key, value = unused_name(docs, "_stratum"), unused_name(docs, "_cutoffs")
    table = cutoffs.select(F.col("stratum").alias(key), F.col("cutoffs").alias(value))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.join(F.broadcast(table) if few else table, F.col(stratum).cast("string").eqNullSafe(F.col(key)), "left")
    rows, m = _measured(rows, body)
    words = m["words"]
    failed = (words["n_words"] < 50) | (100 * words["n_repeat_words"] > 50 * words["n_words"])
    refused = F.lit(False)
    for r, share in enumerate(_shares(m)):
        refused = refused | F.coalesce(share > F.col(value)[r], F.lit(False))
    rules = F.struct(
        words["n_words"].alias("n_words"),
        m["word_chars"].alias("word_chars"),
        m["symbols"].alias("n_symbols"),
        (m["lines"]["n"] - m["lines"]["n_distinct"]).alias("n_dup_lines"),
        words["n_repeat_words"].alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & ~refused).alias("kept"),
    )
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], rules.alias("quality_rules"))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that all rules keep, with their columns."""
    rows = judged(docs, fit_cutoffs(docs, labels))
    # A filter would move below the measures and work them out a second time; a list of one or no element does not.
    once = unused_name(rows, "_once")
    kept = rows.withColumn(once, F.explode(F.expr("if(quality_rules.kept, array(1), array())")))
    return kept.drop("quality_rules", once)


def op8_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and the verdict for every document."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    cutoffs = fit_cutoffs(docs, load(spark, sf_dir, "labels"))
    return judged(docs, cutoffs).select("doc_id", "quality_rules.*")


ORACLE_SQL = rf"""
WITH base AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, text IS NOT NULL AND doc_id IS NOT NULL AS counts,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, (words[i], words[i + 1], words[i + 2]) AS w
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 2)) AS i FROM base)),
repeated AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY doc_id),
measured AS (
  SELECT b.doc_id, lang, text, counts, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '{_SYMBOLS}', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals,
         length(text) - length(replace(text, '!', '')) AS n_exclamations,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM base b LEFT JOIN covered c ON b.doc_id = c.doc_id),
shares AS (
  SELECT doc_id, lang, counts, [n_symbols / greatest(word_chars, 1), n_capitals / greatest(word_chars, 1),
         n_exclamations / greatest(word_chars, 1), n_dup_lines / greatest(n_lines, 1)] AS v FROM measured),
grid AS (SELECT {list(map(float, GRID))}::DOUBLE[] AS cuts),
held AS (
  SELECT lang, v, left(md5(CAST(doc_id AS VARCHAR)), 1) < '4' AS proposes FROM shares
  JOIN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1) USING (doc_id) WHERE counts),
refusals AS (
  SELECT lang, r, c, count(*) FILTER (proposes AND v[r] > cuts[c]) AS k, count(*) FILTER (proposes) AS n
  FROM held, grid, range(1, {len(RULES)} + 1) AS rules(r), range(1, {len(GRID)} + 1) AS steps(c) GROUP BY ALL),
proposed AS (
  SELECT lang, r, count(*) FILTER (k <= CAST({RISK / len(RULES)} AS DOUBLE) * n) AS steps,
         row_number() OVER (PARTITION BY lang ORDER BY sum(k), r) - 1 AS j
  FROM refusals GROUP BY lang, r),
reached AS (
  SELECT h.lang, h.i, min({len(GRID)} * j + len(list_filter(cuts, lambda cut: cut >= v[r])))
         FILTER (len(list_filter(cuts, lambda cut: cut >= v[r])) < steps) AS first
  FROM (SELECT *, row_number() OVER () AS i FROM held WHERE NOT proposes) h JOIN proposed p ON h.lang IS NOT DISTINCT FROM p.lang, grid GROUP BY ALL),
unions AS (
  SELECT lang, s, count(*) AS n, count(*) FILTER (first <= s) AS k
  FROM reached, range(0, {len(RULES) * len(GRID)}) AS steps(s) GROUP BY lang, s),
tails AS (
  SELECT lang, s, CASE WHEN k >= n * {RISK} THEN 1.0 ELSE (
    SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln(1 - {RISK})))
    FROM (SELECT unnest(generate_series(0, k)) AS i)) END AS p
  FROM unions),
passed AS (SELECT lang, count(*) FILTER (p <= {ERROR} / (SELECT count(DISTINCT coalesce(lang, '')) FROM held)) AS passed FROM tails GROUP BY lang),
cutoffs AS (
  SELECT p.lang, r, cuts[least(passed - {len(GRID)} * j, steps)] AS cut
  FROM proposed p JOIN passed t ON p.lang IS NOT DISTINCT FROM t.lang, grid WHERE least(passed - {len(GRID)} * j, steps) > 0),
refused AS (SELECT DISTINCT doc_id FROM shares s JOIN cutoffs c ON s.lang IS NOT DISTINCT FROM c.lang WHERE v[r] > cut),
verdict AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM measured)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM refused) AS kept
FROM verdict"""
