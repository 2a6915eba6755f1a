"""Metrics, calibration, agreement, judging, retrieval and evidence over the evaluation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigrade.functions import metrics as m
from verdigrade.functions import text as t
from verdigrade.operators import calibration as cal
from verdigrade.operators import graph, judging, rag, rollup, vectors
from verdigrade.plans import views as v
from verdigrade.plans.views import CAND_SQL, CASES_SQL, GEN_SQL, JUDGE_SQL, RESP_SQL
from verdigrade.session import table


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return v.gen(spark, d).select("example_id", "task_type", "output", "reference")


def exact_match(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("example_id", m.exact_match(F.col("output"), F.col("reference")).alias("value"))


def squad_f1(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("example_id", m.squad_f1(F.col("output"), F.col("reference")).alias("value"))


def normalized_levenshtein(spark: SparkSession, d: str) -> DataFrame:
    ascii_ = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "")
    return _pairs(spark, d).select("example_id", m.levenshtein_similarity(ascii_(F.col("output")), ascii_(F.col("reference"))).alias("value"))


def normalized_levenshtein_raw(spark: SparkSession, d: str) -> DataFrame:
    """The metric as defined, on raw texts. No SQL: DuckDB's distance counts bytes."""
    return _pairs(spark, d).select("example_id", m.levenshtein_similarity(F.col("output"), F.col("reference")).alias("value"))


def assertions(spark: SparkSession, d: str) -> DataFrame:
    must = F.when(F.col("reference").isNotNull(), F.array("reference"))
    return _pairs(spark, d).select("example_id", m.assertions(F.col("output"), must, F.array(F.lit("sorry"), F.lit("cannot"))).alias("value"))


def numeric_assertion(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("example_id", m.numeric_assertion(F.col("output"), F.col("reference")).alias("value"))


def json_validity(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).where("task_type = 'extraction'").select("example_id", m.json_validity(F.col("output")).alias("value"))


def json_field_f1_flat(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "props", F.to_json(F.struct(F.lit(7).alias("k"), F.lit("x").alias("z"))).alias("want"))
    return e.select("event_id", m.json_field_f1(F.col("props"), F.col("want")).alias("value"))


def classification_match(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).where("task_type = 'classification'").select("example_id", m.classification(F.col("output"), F.col("reference")).alias("value"))


def rouge_1(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("example_id", F.round(m.rouge(F.col("output"), F.col("reference"))["rouge_1"], 9).alias("value"))


def rouge_2(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("example_id", F.round(m.rouge(F.col("output"), F.col("reference"))["rouge_2"], 9).alias("value"))


def rouge_l(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("example_id", m.rouge(F.col("output"), F.col("reference"))["rouge_l"].alias("value"))


def chrf_pp(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("example_id", m.chrf_pp(F.col("output"), F.col("reference")).alias("value"))


def meteor(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("example_id", m.meteor(F.col("output"), F.col("reference")).alias("value"))


_BLEU = m.BLEU_STATS


def sacrebleu_corpus(spark: SparkSession, d: str) -> DataFrame:
    rows = _pairs(spark, d).where("output is not null and reference is not null").select("task_type", m.bleu_stats(F.col("output"), F.col("reference")).alias("s"))
    sums = rows.groupBy("task_type").agg(*(F.sum(f"s.{c}").alias(c) for c in _BLEU))
    return sums.select("task_type", m.bleu_of({c: F.col(c) for c in _BLEU}).alias("bleu"))


def registry_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _pairs(spark, d).select("*", F.array().cast("array<string>").alias("must_contain"), F.array().cast("array<string>").alias("must_not_contain"), F.lit(None).cast("string").alias("reference_answer"), F.lit(None).cast("array<string>").alias("references"))
    names = ("exact_match", "squad_f1", "numeric_assertion", "assertions")
    wide = rows.select("task_type", *(m.REGISTRY.get(n).value().alias(n) for n in names))
    long = rollup.wide_to_long(wide, ["task_type"], {n: m.REGISTRY.get(n).threshold for n in names})
    return long.groupBy("task_type", "metric").agg(F.count("value").alias("n"), F.count_if(F.col("value") >= F.col("threshold")).alias("n_passed"))


# Two raters of one generation: its first judgment and its first calibration response.


def _ratings(spark: SparkSession, d: str) -> DataFrame:
    a = v.judged(spark, d).where("generation_id is not null and score is not null").groupBy("generation_id").agg(F.min_by("score", "judgment_id").alias("a"))
    b = v.resp(spark, d).where("generation_id is not null and score is not null").groupBy("generation_id").agg(F.min_by("score", "response_id").alias("b"))
    return a.join(b, "generation_id")


def classification_confusion(spark: SparkSession, d: str) -> DataFrame:
    return rollup.confusion(_ratings(spark, d), "a", "b")


def classification_report(spark: SparkSession, d: str) -> DataFrame:
    return rollup.classification_report(classification_confusion(spark, d))


def _table(spark: SparkSession, d: str) -> DataFrame:
    return cal.rating_table(_ratings(spark, d), "a", "b")


def cohen_kappa(spark: SparkSession, d: str) -> DataFrame:
    return cal.cohen_kappa(_table(spark, d))


def spearman(spark: SparkSession, d: str) -> DataFrame:
    return cal.spearman(_table(spark, d))


def krippendorff_nominal(spark: SparkSession, d: str) -> DataFrame:
    return cal.krippendorff(_table(spark, d), ordinal=False)


def krippendorff_ordinal(spark: SparkSession, d: str) -> DataFrame:
    return cal.krippendorff(_table(spark, d), ordinal=True)


def _confidences(spark: SparkSession, d: str) -> DataFrame:
    return v.gen(spark, d).where("passed is not null and metric_value is not null and not isnan(metric_value)").select(F.col("passed").alias("correct"), F.round("metric_value", 4).alias("confidence"))


def adaptive_ece(spark: SparkSession, d: str) -> DataFrame:
    return cal.adaptive_ece(_confidences(spark, d), "correct", "confidence")


def reliability_bins(spark: SparkSession, d: str) -> DataFrame:
    return cal.reliability(_confidences(spark, d), "correct", "confidence").select(F.col("bin").cast("bigint").alias("bin"), "n", "accuracy", "confidence")


def brier_nll(spark: SparkSession, d: str) -> DataFrame:
    return cal.brier_nll(_confidences(spark, d), "correct", "confidence")


def risk_coverage(spark: SparkSession, d: str) -> DataFrame:
    return cal.risk_coverage(_confidences(spark, d), "correct", "confidence")


def risk_coverage_aurc(spark: SparkSession, d: str) -> DataFrame:
    return cal.risk_summary(_confidences(spark, d), "correct", "confidence").select("aurc")


def accuracy_at_80(spark: SparkSession, d: str) -> DataFrame:
    return cal.risk_summary(_confidences(spark, d), "correct", "confidence").select(F.col("accuracy_at").alias("accuracy_at_80"))


def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return cal.roc_auc(_confidences(spark, d), "correct", "confidence")


def pr_auc(spark: SparkSession, d: str) -> DataFrame:
    return cal.pr_auc(_confidences(spark, d), "correct", "confidence")


def calibrate_threshold(spark: SparkSession, d: str) -> DataFrame:
    return cal.best_threshold(_confidences(spark, d), "correct", "confidence")


def _duels(spark: SparkSession, d: str) -> DataFrame:
    """Two models' judgments of one generation as a pair; it was shown swapped where the later judgment's id is odd."""
    j = v.judged(spark, d).where("generation_id is not null and score is not null").select("generation_id", "judgment_id", F.col("judge_model").alias("model"), "score")
    one = j.groupBy("generation_id", "model").agg(F.min(F.struct("judgment_id", "score")).alias("r")).select("generation_id", "model", "r.*")
    a, b = (one.toDF("generation_id", *(f"{c}_{x}" for c in ("model", "judgment_id", "score"))) for x in "ab")
    p = a.join(b, "generation_id").where("model_a < model_b")
    shown = F.when(F.col("score_a") == F.col("score_b"), "tie").when(F.col("score_a") > F.col("score_b"), "A").otherwise("B")
    return p.select("generation_id", "model_a", "model_b", (F.greatest("judgment_id_a", "judgment_id_b") % 2).cast("int").alias("swap"), shown.alias("shown"))


def pairwise_swap_resolution(spark: SparkSession, d: str) -> DataFrame:
    return _duels(spark, d).withColumn("preference", judging.original_preference(F.col("shown"), F.col("swap")))


def win_rates(spark: SparkSession, d: str) -> DataFrame:
    return judging.win_rates(pairwise_swap_resolution(spark, d))


def position_bias(spark: SparkSession, d: str) -> DataFrame:
    return judging.position_bias(_duels(spark, d))


def swap_consistency(spark: SparkSession, d: str) -> DataFrame:
    p = pairwise_swap_resolution(spark, d).withColumn("pair", F.concat_ws("|", "model_a", "model_b", "generation_id"))
    return judging.swap_consistency(p.unionByName(p.withColumn("swap", 1 - F.col("swap"))), "pair")


def connected_components(spark: SparkSession, d: str) -> DataFrame:
    e = pairwise_swap_resolution(spark, d).where("preference <> 'tie'").select(F.col("model_a").alias("a"), F.col("model_b").alias("b")).distinct()
    nodes = v.judged(spark, d).select(F.col("judge_model").alias("node")).distinct()
    return graph.component_sizes(graph.components(nodes, e))


def node_degrees(spark: SparkSession, d: str) -> DataFrame:
    e = pairwise_swap_resolution(spark, d).where("preference <> 'tie'").select(F.col("model_a").alias("a"), F.col("model_b").alias("b")).distinct()
    return graph.degrees(v.judged(spark, d).select(F.col("judge_model").alias("node")).distinct(), e)


# Retrieval: vectors whose id is divisible by 20 against all; those of the same label are relevant, with gain 1 to 3.


RANKED = range(1, 21)


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, rank, qrels, n_relevant): qrels hold what is relevant among the 20 found and, under other names, as many of the best others as a rank could hold."""
    e = table(spark, d, "embeddings")
    near = vectors.nearest(e.where("vec_id % 20 = 0"), e, 20)
    per = near.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "vec_id"))), lambda x: x["vec_id"].cast("string")).alias("rank"))  # 20 a query
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    gain = (1 + F.col("vec_id") % 3).cast("int")
    labels = e.groupBy("label").agg(*(F.count_if(gain == g).alias(f"n{g}") for g in (1, 2, 3)))  # what is relevant is counted, not listed
    found = near.join(e.select("vec_id", F.col("label").alias("of")), "vec_id").join(q, "query_id").where("of = label")
    ranked = found.groupBy("query_id").agg(F.collect_list(F.struct(F.col("vec_id").cast("string").alias("k"), gain.alias("g"))).alias("x"), *(F.count_if(gain == g).alias(f"r{g}") for g in (1, 2, 3)))  # 20 a query
    both = q.join(labels, "label").join(ranked, "query_id", "left").na.fill(0)
    own = (1 + F.col("query_id") % 3).cast("int")
    missed = lambda g: F.col(f"n{g}") - F.col(f"r{g}") - (own == g).cast("int")

    def listed(g: int) -> Column:
        return F.transform(F.slice(F.array(*(F.lit(str(i)) for i in RANKED)), F.lit(1), F.least(missed(g), F.lit(len(RANKED))).cast("int")), lambda i: F.struct(F.concat(F.lit(f"missed {g} "), i).alias("k"), F.lit(g).alias("g")))

    others = [listed(g) for g in (3, 2, 1)]
    qrels = F.map_from_entries(F.concat(F.coalesce("x", F.array().cast("array<struct<k:string,g:int>>")), *others))
    n_relevant = F.col("n1") + F.col("n2") + F.col("n3") - 1
    return per.join(both.where(n_relevant > 0).select("query_id", qrels.alias("qrels"), n_relevant.alias("n_relevant")), "query_id")


def nearest_neighbours(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return vectors.nearest(e.where("vec_id % 20 = 0"), e, 20).select("query_id", "vec_id", F.round("cosine", 9).alias("cosine"), "place")


def _ranking_metric(f, of_all: bool = False):
    """of_all: the value is a share of all that is relevant, not of what qrels list."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        value = f(F.col("rank"), F.col("qrels"))
        value = value * F.size("qrels") / F.col("n_relevant") if of_all else value
        return _ranked(spark, d).select("query_id", F.round(value, 9).alias("value"))

    return query


ndcg_at_10 = _ranking_metric(m.ndcg_at)
precision_at_k = _ranking_metric(m.precision_at)
recall_at_20 = _ranking_metric(lambda r, q: m.recall_at(r, q, 20), True)
mrr = _ranking_metric(m.reciprocal_rank)
map = _ranking_metric(m.average_precision, True)


def cosine_max_reference(spark: SparkSession, d: str) -> DataFrame:
    near = vectors.nearest(table(spark, d, "embeddings").where("vec_id % 20 = 0"), table(spark, d, "embeddings"), 1)
    return near.select("query_id", F.round("cosine", 9).alias("value"))


def centroid_similarity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    c = vectors.centroid(e, "label", "embedding")
    unit = F.transform("embedding", lambda x: x.cast("double"))
    return e.join(c, "label").select("vec_id", F.round(m.cosine(unit, F.col("centroid")), 9).alias("value"))


def claim_split(spark: SparkSession, d: str) -> DataFrame:
    rows = rag.claim_rows(v.cand(spark, d), "generation_id", "candidate_text")
    return rows.groupBy("generation_id").agg(F.count(F.lit(1)).alias("n_claims"), F.sum(F.length("claim")).alias("n_chars"))


def context_precision_recall(spark: SparkSession, d: str) -> DataFrame:
    r = _ranked(spark, d).select("query_id", "rank", F.map_keys("qrels").alias("relevant"), "n_relevant")
    return rag.context_scores(r, "rank", "relevant").agg(F.count(F.lit(1)).alias("n"), F.avg("context_precision").alias("context_precision"), F.avg(F.col("context_recall") * F.size("relevant") / F.col("n_relevant")).alias("context_recall"))


def _entailments(spark: SparkSession, d: str) -> DataFrame:
    """Claims of candidates against their case's reference: one that holds the reference's text entails."""
    c = v.cand(spark, d).where("reference is not null and reference <> ''")
    return c.select("generation_id", "reference", F.posexplode(t.claims(F.col("candidate_text"))).alias("claim_index", "claim")).withColumn("label", F.when(F.contains("claim", "reference"), "entailment").otherwise("neutral"))


def unsupported_claim_rate(spark: SparkSession, d: str) -> DataFrame:
    return rag.unsupported_rate(_entailments(spark, d), ["generation_id", "claim_index"])


def citation_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Judgments as citations of generations: present if the generation exists, relevant from score 4, entailed if its source is known."""
    c = v.cand(spark, d).select("generation_id", F.lit(True).alias("present"), F.col("source").isNotNull().alias("has_source"))
    j = v.judged(spark, d).where("generation_id is not null").select("generation_id", (F.col("score") >= 4).alias("relevant"))
    return rag.citation_attribution(j.join(c, "generation_id", "left").select("present", "relevant", (F.col("has_source") & (F.length("generation_id") % 2 == 1)).alias("entailed")))


def redact_secrets(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("token="), F.col("case_id"), F.lit(" api_key: "), F.col("generation_id"), F.lit("  Authorization: Bearer "), F.col("generation_id"), F.lit("; "), F.coalesce("prompt", F.lit("")))
    return v.cand(spark, d).where("case_id is not null").select("generation_id", t.redact(text, 240).alias("clean"))


def truncate_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.length(t.truncate(F.col("text"), 280)).alias("n"), F.left(t.truncate(F.col("text"), 280), F.lit(40)).alias("head"))


def outcome_classes(spark: SparkSession, d: str) -> DataFrame:
    g = v.gen(spark, d)
    reason = F.when(F.col("outcome") == "truncated", "length").when(F.col("outcome") == "content_filtered", "content_filter").otherwise("stop")
    return g.groupBy(t.outcome(F.col("output"), reason, F.col("outcome") == "harness_timeout", F.col("outcome") == "harness_error").alias("class")).agg(F.count(F.lit(1)).alias("n"))


def mock_provider(spark: SparkSession, d: str) -> DataFrame:
    from verdigrade.sources.providers import mock_answers

    asked = v.cases(spark, d).select("case_id", F.concat(F.lit("What is "), F.length("inputs"), F.lit(" plus one?")).alias("prompt"))
    return mock_answers(asked, "prompt").select("case_id", "output", "total_ms", "prompt_tokens")


_G = f"WITH {GEN_SQL}"
_C = f"WITH {CAND_SQL}"
_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
_NORM = r"trim(regexp_replace(array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(replace(replace({}, chr(160), ' '), '…', '...')), '[^\p{{L}}\p{{N}}_\s.-]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: w NOT IN ('a', 'an', 'the')), ' '), '\s+', ' ', 'g'))"
_ASC = r"regexp_replace({}, '[^\x00-\x7F]', '', 'g')"
_NUM = r"regexp_extract_all({}, '[-+]?\d*\.?\d+')"


def _overlap_sql(n: int) -> str:
    """F1 of n-gram multisets by example_id."""
    g = lambda c: f"SELECT example_id, array_to_string(w[i:i+{n - 1}], ' ') AS g, count(*) AS n FROM (SELECT example_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM (SELECT example_id, {_TOK.format(c)} AS w FROM gen WHERE output IS NOT NULL AND reference IS NOT NULL) WHERE len(w) >= {n}) GROUP BY 1, 2"
    return f"a AS ({g('output')}), b AS ({g('reference')}), h AS (SELECT a.example_id, sum(least(a.n, b.n)) AS h FROM a JOIN b USING (example_id, g) GROUP BY 1), x AS (SELECT example_id, sum(n) AS x FROM a GROUP BY 1), y AS (SELECT example_id, sum(n) AS y FROM b GROUP BY 1)"


def _bleu_sql() -> str:
    def tok(c: str) -> str:
        space = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
        line = f"replace(replace(replace(regexp_replace({c}, '{space}$', ''), '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
        for a, b in m.UNESCAPED_13A:
            line = f"replace({line}, '{a}', '{b}')"
        line = f"' ' || {line} || ' '"
        for pattern, becomes in m.TOKENS_13A:
            line = f"regexp_replace({line}, '{pattern}', '{becomes}', 'g')"
        return f"list_filter(regexp_split_to_array({line}, '{space}'), lambda x: x <> '')"

    parts, names = [f"p AS (SELECT example_id, task_type, {tok('output')} AS o, {tok('reference')} AS r FROM gen WHERE output IS NOT NULL AND reference IS NOT NULL)"], []
    for n in range(1, 5):
        for s in "or":
            parts.append(f"g{s}{n} AS (SELECT example_id, task_type, array_to_string({s}[i:i+{n - 1}], chr(1)) AS g, count(*) AS n FROM (SELECT example_id, task_type, {s}, unnest(range(1, len({s}) - {n - 2})) AS i FROM p WHERE len({s}) >= {n}) GROUP BY 1, 2, 3)")
        parts.append(f"h{n} AS (SELECT a.task_type, sum(least(a.n, b.n)) AS h FROM go{n} a JOIN gr{n} b USING (example_id, g) GROUP BY 1), t{n} AS (SELECT task_type, sum(n) AS t FROM go{n} GROUP BY 1)")
        names.append(f"(SELECT h FROM h{n} WHERE h{n}.task_type IS NOT DISTINCT FROM l.task_type) AS h{n}, (SELECT t FROM t{n} WHERE t{n}.task_type IS NOT DISTINCT FROM l.task_type) AS t{n}")
    parts.append("l AS (SELECT task_type, sum(len(o)) AS o, sum(len(r)) AS r FROM p GROUP BY 1), s AS (SELECT l.*, " + ", ".join(names) + " FROM l)")
    logs = " + ".join(f"ln(h{n} / t{n}::DOUBLE)" for n in range(1, 5))
    return f"{_G}, {', '.join(parts)} SELECT task_type, CASE WHEN coalesce(h1,0) = 0 OR coalesce(h2,0) = 0 OR coalesce(h3,0) = 0 OR coalesce(h4,0) = 0 THEN 0.0 ELSE exp(CASE WHEN o >= r THEN 0 ELSE 1 - r / o::DOUBLE END + ({logs}) / 4) END AS bleu FROM s"


_RATE = f"""WITH {JUDGE_SQL}, {RESP_SQL}, ra AS (SELECT generation_id, arg_min(score, judgment_id) AS a FROM judged WHERE generation_id IS NOT NULL AND score IS NOT NULL GROUP BY 1),
rb AS (SELECT generation_id, arg_min(score, response_id) AS b FROM resp WHERE generation_id IS NOT NULL AND score IS NOT NULL GROUP BY 1), r AS (SELECT a, b FROM ra JOIN rb USING (generation_id))"""
_CONF = f"{_G}, f AS (SELECT passed::INT AS y, least(1-1e-12, greatest(1e-12, round(metric_value, 4))) AS p FROM gen WHERE passed IS NOT NULL AND metric_value IS NOT NULL AND NOT isnan(metric_value)), m AS (SELECT p, y, avg(y) OVER (PARTITION BY p) AS h FROM f)"
_BINS = f"{_CONF}, b AS (SELECT p, h, ntile(15) OVER (ORDER BY p) - 1 AS bin FROM m)"
_RISK = f"{_CONF}, k AS (SELECT row_number() OVER (ORDER BY p DESC) AS i, sum(1 - h) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS e, count(*) OVER () AS n FROM m), q AS (SELECT i, e / i AS risk, n FROM k)"
_CUM = f"{_CONF}, d AS (SELECT p, count(*) AS n, sum(y) AS y FROM f GROUP BY 1), k AS (SELECT p, y, n, sum(n) OVER (ORDER BY p DESC) AS rn, sum(y) OVER (ORDER BY p DESC) AS ry, sum(y) OVER () AS pos, sum(n) OVER () AS al FROM d)"
_DUEL = f"""WITH {JUDGE_SQL}, one AS (SELECT generation_id, judge_model AS model, min(judgment_id) AS judgment_id, arg_min(score, judgment_id) AS score FROM judged WHERE generation_id IS NOT NULL AND score IS NOT NULL GROUP BY 1, 2),
duel AS (SELECT a.generation_id, a.model AS model_a, b.model AS model_b, (greatest(a.judgment_id, b.judgment_id) % 2)::INT AS swap, CASE WHEN a.score = b.score THEN 'tie' WHEN a.score > b.score THEN 'A' ELSE 'B' END AS shown FROM one a JOIN one b ON a.generation_id = b.generation_id AND a.model < b.model),
res AS (SELECT *, CASE WHEN swap = 1 AND shown = 'A' THEN 'B' WHEN swap = 1 AND shown = 'B' THEN 'A' ELSE shown END AS preference FROM duel)"""
_NEAR = """WITH n AS (SELECT q.vec_id AS query_id, q.label AS ql, r.vec_id, r.label, list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS cosine FROM embeddings q JOIN embeddings r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 12) DESC, vec_id)::INT AS place FROM n QUALIFY place <= 20),
rel AS (SELECT query_id, count(*) AS total FROM n WHERE ql = label GROUP BY 1), x AS (SELECT k.*, total, ql = label AS hit, 1 + vec_id % 3 AS gain FROM k JOIN rel USING (query_id))"""
_CL = r"""cl AS (SELECT generation_id, reference, i - 1 AS claim_index, claim FROM (SELECT generation_id, reference, unnest(range(1, len(c) + 1)) AS i, unnest(c) AS claim FROM (SELECT generation_id, reference, list_filter(list_transform(string_split(regexp_replace(regexp_replace({held}, '([.!?])\s+', '\1' || chr(3), 'g'), '[\r\n\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]+', chr(3), 'g'), chr(3)), lambda x: {back}), lambda x: x <> '')[1:20] AS c FROM cand)))"""
_HELD, _BACK = "replace(candidate_text, chr(160), ' ')", "trim(regexp_replace(x, '\\s+', ' ', 'g'))"
for _i, _a in enumerate(t.ABBREVIATIONS):
    _HELD = f"replace({_HELD}, '{_a}', chr(1) || '{_i}' || chr(2))"
    _BACK = f"replace({_BACK}, chr(1) || '{_i}' || chr(2), '{_a}')"
_BACK = f"CASE WHEN len({_BACK}) <= 280 THEN {_BACK} ELSE {_BACK}[1:279] || '…' END"
_CLAIMS = f"{_C}, {_CL.format(held=_HELD, back=_BACK)}"
_RED = "'token=' || case_id || ' api_key: ' || generation_id || '  Authorization: Bearer ' || generation_id || '; ' || coalesce(prompt, '')"
_RED = f"trim(regexp_replace(replace({_RED}, chr(160), ' '), '\\s+', ' ', 'g'))"
for _p in t.SECRETS:
    _RED = "regexp_replace({}, '{}', '\\1[REDACTED]', 'g')".format(_RED, _p.replace("'", "''"))
_FLAT = r"trim(regexp_replace(replace(text, chr(160), ' '), '\s+', ' ', 'g'))"
_TRUNC = f"CASE WHEN len({_FLAT}) <= 280 THEN {_FLAT} ELSE {_FLAT}[1:279] || '…' END"

ORACLE = {
    "exact_match": f"{_G} SELECT example_id, ({_NORM.format('output')} = {_NORM.format('reference')})::INT::DOUBLE AS value FROM gen",
    "squad_f1": f"{_G}, {_overlap_sql(1)} SELECT g.example_id, CASE WHEN output IS NULL OR reference IS NULL THEN NULL WHEN x IS NULL AND y IS NULL THEN 1.0 WHEN h IS NULL THEN 0.0 ELSE 2.0 * h / (x + y) END AS value FROM gen g LEFT JOIN h USING (example_id) LEFT JOIN x USING (example_id) LEFT JOIN y USING (example_id)",
    "normalized_levenshtein": f"{_G}, s AS (SELECT example_id, {_ASC.format('output')} AS o, {_ASC.format('reference')} AS r FROM gen) SELECT example_id, CASE WHEN o IS NULL OR r IS NULL THEN NULL WHEN greatest(len(o), len(r)) = 0 THEN 1.0 ELSE 1 - levenshtein(o, r) / greatest(len(o), len(r))::DOUBLE END AS value FROM s",
    "assertions": f"{_G} SELECT example_id, CASE WHEN output IS NULL THEN 0.0 ELSE ((reference IS NULL OR contains(lower(output), lower(reference))) AND NOT contains(lower(output), 'sorry') AND NOT contains(lower(output), 'cannot'))::INT::DOUBLE END AS value FROM gen",
    "numeric_assertion": f"{_G}, s AS (SELECT example_id, {_NUM.format('output')} AS a, {_NUM.format('reference')} AS b FROM gen) SELECT example_id, CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN len(a) <> len(b) THEN 0.0 ELSE (len(list_filter(list_zip(a, b), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE) > greatest(1e-6 * greatest(abs(z[1]::DOUBLE), abs(z[2]::DOUBLE)), 1e-6))) = 0)::INT::DOUBLE END AS value FROM s",
    "json_validity": f"{_G} SELECT example_id, coalesce(json_valid(output), false)::INT::DOUBLE AS value FROM gen WHERE task_type = 'extraction'",
    "json_field_f1_flat": "WITH s AS (SELECT event_id, coalesce((json_extract(props, '$.k')::VARCHAR = '7'), false)::INT AS h, len(json_keys(props)) AS n FROM events) SELECT event_id, CASE WHEN h = 0 THEN 0.0 ELSE 2.0 * h / (n + 2) END AS value FROM s",
    "classification_match": rf"{_G} SELECT example_id, (regexp_replace(output, '^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g') = reference)::INT::DOUBLE AS value FROM gen WHERE task_type = 'classification'",
    "rouge_1": f"{_G}, {_overlap_sql(1)} SELECT g.example_id, CASE WHEN output IS NULL OR reference IS NULL THEN NULL ELSE round(coalesce(2.0 * h / (coalesce(x, 0) + coalesce(y, 0)), 0), 9) END AS value FROM gen g LEFT JOIN h USING (example_id) LEFT JOIN x USING (example_id) LEFT JOIN y USING (example_id)",
    "rouge_2": f"{_G}, {_overlap_sql(2)} SELECT g.example_id, CASE WHEN output IS NULL OR reference IS NULL THEN NULL ELSE round(coalesce(2.0 * h / (coalesce(x, 0) + coalesce(y, 0)), 0), 9) END AS value FROM gen g LEFT JOIN h USING (example_id) LEFT JOIN x USING (example_id) LEFT JOIN y USING (example_id)",
    "sacrebleu_corpus": _bleu_sql(),
    "classification_confusion": f"{_RATE} SELECT a AS expected, b AS predicted, count(*) AS n FROM r GROUP BY 1, 2",
    "classification_report": f"""{_RATE}, l AS (SELECT DISTINCT a AS c FROM r UNION SELECT DISTINCT b FROM r), q AS (SELECT c, (SELECT count(*) FROM r WHERE a = c) AS s, (SELECT count(*) FROM r WHERE b = c) AS p, (SELECT count(*) FROM r WHERE a = c AND b = c) AS h FROM l),
z AS (SELECT sum(s)::DOUBLE AS n, sum(h)::DOUBLE AS h, avg(CASE WHEN s > 0 THEN h / s::DOUBLE END) AS ba, avg(2.0 * h / (s + p)) AS mf, sum(s * coalesce(h / nullif(p, 0)::DOUBLE, 0)) AS wp, sum(s * coalesce(h / nullif(s, 0)::DOUBLE, 0)) AS wr, sum(s * 2.0 * h / (s + p)) AS wf, sum(s * p)::DOUBLE AS sp, sum(p * p)::DOUBLE AS pp, sum(s * s)::DOUBLE AS ss FROM q)
SELECT n::BIGINT AS n, h / n AS accuracy, ba AS balanced_accuracy, mf AS macro_f1, h / n AS micro_f1, wp / n AS weighted_precision, wr / n AS weighted_recall, wf / n AS weighted_f1, (h * n - sp) / sqrt((n * n - pp) * (n * n - ss)) AS mcc, (h / n - sp / (n * n)) / (1 - sp / (n * n)) AS kappa FROM z""",
    "cohen_kappa": f"{_RATE}, z AS (SELECT avg((a = b)::INT) AS po, (SELECT sum(x.n * y.n) FROM (SELECT a, count(*) AS n FROM r GROUP BY 1) x JOIN (SELECT b, count(*) AS n FROM r GROUP BY 1) y ON x.a = y.b) / (count(*) * count(*))::DOUBLE AS pe FROM r) SELECT (po - pe) / (1 - pe) AS kappa FROM z",
    "spearman": f"{_RATE}, k AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS x, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS y FROM r) SELECT corr(x, y) AS rho FROM k",
    "krippendorff_nominal": f"{_RATE}, u AS (SELECT a AS c FROM r UNION ALL SELECT b FROM r), e AS (SELECT 1 - sum(n * n) / (sum(n) * sum(n))::DOUBLE AS e FROM (SELECT count(*) AS n FROM u GROUP BY c)) SELECT 1 - avg((a <> b)::INT) / max(e) AS alpha FROM r, e",
    "krippendorff_ordinal": f"{_RATE}, u AS (SELECT a::DOUBLE AS c FROM r UNION ALL SELECT b FROM r) SELECT 1 - avg((a - b) * (a - b)) / max(e) AS alpha FROM r, (SELECT 2 * (avg(c * c) - avg(c) * avg(c)) AS e FROM u)",
    "adaptive_ece": f"{_BINS}, g AS (SELECT bin, count(*) AS n, avg(h) AS a, avg(p) AS c FROM b GROUP BY 1) SELECT sum(n * abs(a - c)) / sum(n) AS adaptive_ece FROM g",
    "reliability_bins": f"{_BINS} SELECT bin, count(*) AS n, avg(h) AS accuracy, avg(p) AS confidence FROM b GROUP BY 1",
    "brier_nll": f"{_CONF} SELECT avg((p - y) * (p - y)) AS brier, -avg(y * ln(p) + (1 - y) * ln(1 - p)) AS nll FROM f",
    "risk_coverage": f"{_CUM} SELECT p, n, rn / al::DOUBLE AS coverage, 1 - ry / rn::DOUBLE AS risk FROM k",
    "risk_coverage_aurc": f"{_RISK} SELECT (sum(risk) - sum(risk) FILTER (i = 1 OR i = n) / 2) / max(n) AS aurc FROM q",
    "accuracy_at_80": f"{_RISK} SELECT 1 - max(risk) FILTER (i = greatest(1, ceil(0.8 * n))) AS accuracy_at_80 FROM q",
    "roc_auc": f"{_CONF}, k AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM f) SELECT (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS roc_auc FROM k",
    "pr_auc": f"{_CUM} SELECT sum(y * ry / rn::DOUBLE) / max(pos) AS pr_auc FROM k",
    "calibrate_threshold": f"{_CUM} SELECT p AS threshold, 2.0 * ry / (rn + pos) AS f1 FROM k ORDER BY round(2.0 * ry / (rn + pos), 12) DESC, p LIMIT 1",
    "pairwise_swap_resolution": f"{_DUEL} SELECT * FROM res",
    "win_rates": f"{_DUEL}, s AS (SELECT model_a AS model, preference = 'A' AS won FROM res WHERE preference <> 'tie' UNION ALL SELECT model_b, preference = 'B' FROM res WHERE preference <> 'tie') SELECT model, count(*) FILTER (won) AS wins, count(*) AS decided, avg(won::INT) AS win_rate FROM s GROUP BY 1",
    "position_bias": f"{_DUEL} SELECT count(*) AS n_decided, avg((shown = 'A')::INT) AS first_share FROM duel WHERE shown <> 'tie'",
    "swap_consistency": f"{_DUEL} SELECT count(*) AS n_pairs, 1.0::DOUBLE AS consistency FROM res",
    "connected_components": f"{_DUEL}, e AS (SELECT model_a AS a, model_b AS b FROM res WHERE preference <> 'tie' UNION SELECT model_b, model_a FROM res WHERE preference <> 'tie'), h AS (WITH RECURSIVE w AS (SELECT DISTINCT judge_model AS x, judge_model AS y FROM judged UNION SELECT w.x, e.b FROM w JOIN e ON w.y = e.a) SELECT x, min(y) AS component FROM w GROUP BY 1) SELECT component, count(*) AS size FROM h GROUP BY 1",
    "node_degrees": f"{_DUEL}, e AS (SELECT model_a AS a, model_b AS b FROM res WHERE preference <> 'tie' UNION SELECT model_b, model_a FROM res WHERE preference <> 'tie') SELECT n.m AS node, count(DISTINCT e.b) AS degree FROM (SELECT DISTINCT judge_model AS m FROM judged) n LEFT JOIN e ON e.a = n.m AND e.a <> e.b GROUP BY 1",
    "nearest_neighbours": f"{_NEAR} SELECT query_id, vec_id, round(cosine, 9) AS cosine, place FROM k",
    "ndcg_at_10": f"{_NEAR}, i AS (SELECT query_id, (2 ** gain - 1) / log2(1 + row_number() OVER (PARTITION BY query_id ORDER BY gain DESC)) AS g, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC) AS r FROM (SELECT query_id, 1 + vec_id % 3 AS gain FROM n WHERE ql = label)), b AS (SELECT query_id, sum(g) AS best FROM i WHERE r <= 10 GROUP BY 1) SELECT query_id, round(coalesce(sum((2 ** gain - 1) / log2(place + 1)) FILTER (hit AND place <= 10), 0) / max(best), 9) AS value FROM x JOIN b USING (query_id) GROUP BY 1",
    "precision_at_k": f"{_NEAR} SELECT query_id, round(count(*) FILTER (hit AND place <= 10) / 10.0, 9) AS value FROM x GROUP BY 1",
    "recall_at_20": f"{_NEAR} SELECT query_id, round(count(*) FILTER (hit) / max(total)::DOUBLE, 9) AS value FROM x GROUP BY 1",
    "mrr": f"{_NEAR} SELECT query_id, round(coalesce(1.0 / min(place) FILTER (hit), 0), 9) AS value FROM x GROUP BY 1",
    "map": f"{_NEAR}, c AS (SELECT *, sum(hit::INT) OVER (PARTITION BY query_id ORDER BY place) AS so FROM x) SELECT query_id, round(coalesce(sum(so / place::DOUBLE) FILTER (hit), 0) / max(total), 9) AS value FROM c GROUP BY 1",
    "cosine_max_reference": f"{_NEAR} SELECT query_id, round(cosine, 9) AS value FROM k WHERE place = 1",
    "centroid_similarity": "WITH u AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS nn FROM embeddings), c AS (SELECT label, i, avg(x / sqrt(nn)) AS c FROM u GROUP BY 1, 2) SELECT vec_id, round(sum(x * c) / sqrt(sum(x * x) * sum(c * c)), 9) AS value FROM u JOIN c USING (label, i) GROUP BY 1",
    "claim_split": f"{_CLAIMS} SELECT generation_id, count(*) AS n_claims, sum(len(claim))::BIGINT AS n_chars FROM cl GROUP BY 1",
    "context_precision_recall": f"{_NEAR}, s AS (SELECT query_id, count(*) FILTER (hit) / count(*)::DOUBLE AS p, count(*) FILTER (hit) / max(total)::DOUBLE AS r FROM x GROUP BY 1) SELECT count(*) AS n, avg(p) AS context_precision, avg(r) AS context_recall FROM s",
    "unsupported_claim_rate": f"{_CLAIMS} SELECT count(*) AS n_claims, avg((NOT contains(claim, reference))::INT) AS unsupported_rate FROM cl WHERE reference IS NOT NULL AND reference <> ''",
    "citation_attribution": f"WITH {CAND_SQL}, {JUDGE_SQL} SELECT count(*) AS n_citations, avg((c.generation_id IS NOT NULL AND (coalesce(j.score >= 4, false) OR coalesce(c.source IS NOT NULL AND len(j.generation_id) % 2 = 1, false)))::INT) AS attribution FROM judged j LEFT JOIN cand c USING (generation_id) WHERE j.generation_id IS NOT NULL",
    "redact_secrets": f"{_C}, s AS (SELECT generation_id, {_RED} AS x FROM cand WHERE case_id IS NOT NULL) SELECT generation_id, CASE WHEN len(x) <= 240 THEN x ELSE x[1:239] || '…' END AS clean FROM s",
    "truncate_text": f"SELECT doc_id, len({_TRUNC})::INT AS n, ({_TRUNC})[1:40] AS head FROM documents",
    "outcome_classes": rf"{_G} SELECT CASE WHEN outcome = 'harness_timeout' THEN 'harness_timeout' WHEN outcome = 'harness_error' THEN 'harness_error' WHEN coalesce(regexp_replace(output, '^[\s\x0b\x1c-\x1f\x{{0085}}\p{{Z}}]+', ''), '') = '' THEN 'empty_output' WHEN outcome = 'truncated' THEN 'truncated' WHEN outcome = 'content_filtered' THEN 'content_filtered' WHEN regexp_matches(lower(trim(output)), '^(i can''t|i cannot)') THEN 'refused' ELSE 'passed' END AS class, count(*) AS n FROM gen GROUP BY 1",
    "mock_provider": f"WITH {CASES_SQL} SELECT case_id, (len(inputs) + 1)::VARCHAR AS output, 5.0::DOUBLE AS total_ms, 12 AS prompt_tokens FROM cases",
}
NO_SQL = ("normalized_levenshtein_raw", "rouge_l", "chrf_pp", "meteor", "registry_scores")
QUERIES = {name: globals()[name] for name in (*ORACLE, *NO_SQL)}
