"""Retrieval: postings, term selection, weighted BM25, floors, fusion and packing, for many prompts at once.

The corpus is read once, into one narrow table of the asked terms' postings with
each record's length (``index``); numbers of records, lengths and frequencies are
all aggregated from it. Prompts are a small table: their terms filter the exploded
tokens before any shuffle, so that only postings of asked terms move. Scores are negative and lower is better; they are rounded
before ranking, so that near-ties fall the same way everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import duck, stems, text
from ledgerloom.session import saved, table

K1, B = 1.2, 0.75
WEIGHTS = {"subject": 3.0, "object": 2.0, "body": 1.0}
TERMS, RESULTS = 8, 10
#: Prompt terms that are broadcast to the scan of the corpus; more are joined.
BROADCAST_TERMS = 1_000_000


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: the source is the subject, the first 160 characters the object."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("subject"), F.substring("text", 1, 160).alias("object"), F.col("text").alias("body")
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("prompt_id"), F.col("text").alias("prompt"))


def prompt_terms(asked: DataFrame) -> DataFrame:
    """(prompt_id, term): distinct terms of three bytes or more that are no stop words."""
    terms = F.array_distinct(F.transform(text.words(F.col("prompt")), text.fts_term))
    out = asked.select("prompt_id", F.explode(terms).alias("term"))
    return out.where((F.octet_length("term") >= 3) & ~F.col("term").isin(text.STOP_WORDS)).distinct()


def runs(tokens: Column, n: int) -> Column:
    """From each place on, n tokens joined by spaces; null where fewer are left."""
    if n < 2:
        return tokens
    joined = lambda a, b: F.concat(a, F.lit(" "), b)
    if n == 2:
        return F.zip_with(tokens, F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), joined)
    return F.transform(tokens, lambda t, i: F.when(i + n <= F.size(tokens), F.array_join(F.slice(tokens, i + 1, F.lit(n)), " ")))


def token_rows(docs: DataFrame, n: int = 1) -> DataFrame:
    """(id, dl, pos, term, w): each record's index tokens, or runs of n of them joined by spaces, with the weight of their field; fields lie a place apart. Position 0 holds the empty term, so that every record has a row."""
    split = {c: F.split(text.fold(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+") for c in WEIGHTS}
    sized = docs.select("id", *(x.alias(c) for c, x in split.items()))
    # only the first and the last of the parts can be empty
    size = lambda c: F.size(c) - (F.element_at(c, 1) == "").cast("int") - ((F.size(c) > 1) & (F.element_at(c, -1) == "")).cast("int")
    places, edges, upto = [F.array(F.lit(""))], [], F.lit(1)
    for c in WEIGHTS:
        places += [F.col(c), F.array(F.lit(""))]
        upto = upto + F.size(c) + 1
        edges.append(upto)
    dl = sum((size(c) for c in WEIGHTS), F.lit(0)).cast("bigint")
    tokens = F.concat(*places)
    if n > 1:  # made once for all its places
        sized, tokens = sized.select("*", tokens.alias("tokens")), F.col("tokens")
    rows = sized.select("id", dl.alias("dl"), *(e.alias(f"e{i}") for i, e in enumerate(edges)), F.posexplode(runs(tokens, n)).alias("pos", "term"))
    w = F.when(F.col("term") == "", 0.0)
    for i, weight in enumerate(WEIGHTS.values()):
        w = w.when(F.col("pos") < F.col(f"e{i}"), weight)
    return rows.select("id", "dl", "pos", "term", w.alias("w"))


def held_tokens(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """token_rows of the tokens in wanted (term), told in the task that reads the record."""
    rows = token_rows(docs)
    return rows.join(F.broadcast(wanted), "term", "left_semi") if wanted.count() <= BROADCAST_TERMS else rows.join(wanted, "term", "left_semi")


def index(spark: SparkSession, docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, dl, term, f), saved: the record's length and the weighted frequency of each wanted term in it; each record has a row for the empty term as well.

    A term that the index cuts into several tokens (one with an underscore) occurs where
    these stand side by side in a field. Each record's runs of as many tokens meet such
    terms whole, in the task that reads the record: no part of a term that stands alone
    is moved.
    """
    parts = wanted.select("term").distinct().withColumn("parts", text.index_tokens(F.col("term")))
    parts = saved(spark, parts, "parts")
    one, several = parts.where("size(parts) = 1 and parts[0] = term"), parts.where("size(parts) > 1 or size(parts) = 1 and parts[0] != term")
    empty = spark.createDataFrame([("",)], "term string")
    out = held_tokens(docs, one.select("term").union(empty)).groupBy("id", "dl", "term").agg(F.sum("w").alias("f"))
    if not several.isEmpty():
        whole = several.select(F.col("term").alias("phrase"), F.size("parts").alias("n"), F.array_join("parts", " ").alias("term"))
        whole = F.broadcast(whole) if whole.count() <= BROADCAST_TERMS else whole
        for n in sorted(r.n for r in several.select(F.size("parts").alias("n")).distinct().collect()):  # lengths of terms: a few
            found = token_rows(docs, n).join(whole.where(F.col("n") == n).drop("n"), "term")
            out = out.unionByName(found.groupBy("id", "dl", F.col("phrase").alias("term")).agg(F.sum("w").alias("f")))
    return saved(spark, out, "postings")


def selected_terms(terms: DataFrame, df: DataFrame, n: int | Column, most: int = TERMS) -> DataFrame:
    """(prompt_id, term, df, idf, rn): each prompt's rarest terms, without those of a third of the records or more."""
    n = n if isinstance(n, Column) else F.lit(n)
    known = terms.join(df, "term").where((n < 50) | (F.col("df") * 3 <= n))
    scored = known.withColumn("idf", F.round(F.log((n + 1) / (F.col("df") + 1)), 6))
    order = Window.partitionBy("prompt_id").orderBy(F.desc("idf"), F.desc(F.octet_length("term")), "term")
    return scored.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most)


def stem_index(spark: SparkSession, docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """As index, of stems: each distinct word of the corpus is stemmed once, and words with a wanted stem count as that stem."""
    words = token_rows(docs).select("term").where("term <> ''")
    forms = stems.stemmed(words).join(wanted.select(F.col("term").alias("stem")).distinct(), "stem", "left_semi")
    forms = saved(spark, forms.union(spark.createDataFrame([("", "")], "term string, stem string")), "forms")
    met = token_rows(docs).join(F.broadcast(forms) if forms.count() <= BROADCAST_TERMS else forms, "term")
    return saved(spark, met.groupBy("id", "dl", F.col("stem").alias("term")).agg(F.sum("w").alias("f")), "postings")


def expanded(terms: DataFrame, vocabulary: DataFrame, most: int = stems.FORMS) -> DataFrame:
    """(prompt_id, term, form): for each term that the vocabulary (term) doesn't hold, the first words in order that have its Spanish stem."""
    missing = terms.join(vocabulary, "term", "left_anti").withColumn("stem", stems.spanish_stem(F.col("term"))).where("stem is not null")
    forms = vocabulary.select(F.col("term").alias("form"), stems.spanish_stem(F.col("term")).alias("stem")).join(missing.select("stem").distinct(), "stem", "left_semi")
    first = F.row_number().over(Window.partitionBy("stem").orderBy("form"))
    return missing.join(forms.withColumn("n", first).where(F.col("n") <= most), "stem").select("prompt_id", "term", "form")


def search(spark: SparkSession, docs: DataFrame, asked: DataFrame, most: int = TERMS, stem: bool = False) -> tuple[DataFrame, DataFrame]:
    """(prompt_id, id, score, matched): weighted BM25 of the records that hold a selected term, or, with stem, a form of it; and the selected terms."""
    terms = saved(spark, prompt_terms(asked), "terms")
    if stem:
        terms = saved(spark, terms.join(stems.stemmed(terms), "term").select("prompt_id", F.col("stem").alias("term")).distinct(), "stems")
    rows = stem_index(spark, docs, terms) if stem else index(spark, docs, terms)
    total = F.broadcast(rows.where("term = ''").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))  # one row
    found = rows.where("term <> ''")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    chosen = selected_terms(terms.join(total.select("n")), df, F.col("n"), most).drop("n")
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, 1e-6).otherwise(idf)
    f, norm = F.col("f"), K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    hits = found.join(chosen.select("prompt_id", "term", "df"), "term").join(total)
    return hits.groupBy("prompt_id", "id").agg(F.round(-F.sum(idf * f * (K1 + 1) / (f + norm)), 6).alias("score"), F.count("*").alias("matched")), chosen


def bm25(spark: SparkSession, docs: DataFrame, asked: DataFrame, most: int = TERMS) -> DataFrame:
    return search(spark, docs, asked, most)[0]


def top(scored: DataFrame, most: int = RESULTS) -> DataFrame:
    order = Window.partitionBy("prompt_id").orderBy("score", F.desc("id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


# --- SQL of the same, for the oracles -----------------------------------------------------------------------------------------

PROMPTS = "SELECT item_id AS prompt_id, text FROM benchmark"
_BASE = f"""
asked AS (PROMPTS),
docs AS (SELECT doc_id AS id, source AS subject, substr(text, 1, 160) AS object, text AS body FROM documents),
toks AS (
  SELECT id, unnest({duck.index_tokens('subject')}) AS term, 3.0::DOUBLE AS w FROM docs
  UNION ALL SELECT id, unnest({duck.index_tokens('object')}), 2.0 FROM docs
  UNION ALL SELECT id, unnest({duck.index_tokens('body')}), 1.0 FROM docs),
sizes AS (SELECT id, CAST(len({duck.index_tokens('subject')}) + len({duck.index_tokens('object')}) + len({duck.index_tokens('body')}) AS BIGINT) AS dl FROM docs),
posts AS (SELECT id, term, sum(w) AS f FROM toks GROUP BY ALL),
whole AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sizes),
raw_terms AS (SELECT prompt_id, {duck.fts_term('w')} AS term FROM (SELECT prompt_id, unnest(string_split_regex(text, '\\s+')) AS w FROM asked)),
terms AS (SELECT DISTINCT prompt_id, term FROM raw_terms WHERE octet_length(encode(term)) >= 3 AND NOT list_contains({duck.STOP}, term)),
df AS (SELECT term, count(*) AS df FROM posts WHERE term IN (SELECT term FROM terms) GROUP BY term),
ranked AS (
  SELECT prompt_id, term, df, round(ln((n + 1) / (df + 1)), 6) AS idf,
         row_number() OVER (PARTITION BY prompt_id ORDER BY round(ln((n + 1) / (df + 1)), 6) DESC, octet_length(encode(term)) DESC, term) AS rn
  FROM terms JOIN df USING (term), whole WHERE n < 50 OR df * 3 <= n),
chosen AS (SELECT * FROM ranked WHERE rn <= {TERMS}),
scored AS (
  SELECT prompt_id, id,
         round(-sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score,
         count(*) AS matched
  FROM posts JOIN chosen USING (term) JOIN sizes USING (id), whole GROUP BY prompt_id, id),
best AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY prompt_id ORDER BY score, id DESC) AS INTEGER) AS rank FROM scored) WHERE rank <= {RESULTS})
"""


def _sql(select: str, more: str = "", asked: str = PROMPTS) -> str:
    return f"WITH {_BASE.replace('PROMPTS', asked)}{more}\n{select}"


def r5_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(bm25(spark, records(spark, sf_dir), prompts(spark, sf_dir))).select("prompt_id", "rank", "id", "score", "matched")


def r4_term_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, records(spark, sf_dir), prompts(spark, sf_dir))[1].select("prompt_id", "term", "df", "idf", "rn")


def r9_relative_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each prompt's results, those at least half as strong as the best, and the newest if newer than the best."""
    hits = top(bm25(spark, records(spark, sf_dir), prompts(spark, sf_dir)))
    every = Window.partitionBy("prompt_id")
    best, newest = F.min("score").over(every), F.max("id").over(every)
    lead = F.max(F.when(F.col("rank") == 1, F.col("id"))).over(every)
    marked = hits.select("*", best.alias("best"), ((F.col("id") == newest) & (newest > lead)).alias("is_newest"))
    return marked.where((F.col("score") <= F.col("best") * 0.5) | F.col("is_newest")).select("prompt_id", "rank", "id", "score", "is_newest")


def r10_absolute_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that match a third of the prompt's selected terms or more."""
    hits, chosen = search(spark, records(spark, sf_dir), prompts(spark, sf_dir))
    need = chosen.groupBy("prompt_id").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / 3)).cast("bigint").alias("need"))
    return top(hits).join(need, "prompt_id").where("matched >= need").select("prompt_id", "id", "matched", "need")


def r14_rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal ranks (k = 60) of the lexical list and the newest-first list of the same records."""
    hits = top(bm25(spark, records(spark, sf_dir), prompts(spark, sf_dir))).select("prompt_id", "id", "rank")
    newest = Window.partitionBy("prompt_id").orderBy(F.desc("id"))
    lists = hits.unionByName(hits.select("prompt_id", "id", F.row_number().over(newest).alias("rank")))
    return lists.groupBy("prompt_id", "id").agg(F.round(F.sum(1 / (60.0 + F.col("rank"))), 9).alias("fused"))


def r19_prefix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in rank order until the first that overflows 700 tokens, each counted as 200 at most."""
    docs = records(spark, sf_dir)
    hits = top(bm25(spark, docs, prompts(spark, sf_dir))).join(docs.select("id", text.tokens_estimate(F.col("body")).alias("t")), "id")
    cost = hits.withColumn("cost", F.least(F.col("t"), F.lit(200)))
    used = F.sum("cost").over(Window.partitionBy("prompt_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return cost.withColumn("used", used).where("used <= 700").select("prompt_id", "rank", "id", "cost", "used")


def greedy_pack(rows: DataFrame, key: str, order: str, cost: str, item: str, budget: int) -> DataFrame:
    """key, item, order, cost: rows taken in order while they fit, skipping those that don't. A key's rows are a bounded list."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(item).alias("i"), F.col(cost).cast("bigint").alias("c"))))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<struct<o:int,i:bigint,c:bigint>>").alias("kept"))
    step = lambda a, x: F.when(a["used"] + x["c"] <= budget, F.struct((a["used"] + x["c"]).alias("used"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a)
    packed = rows.groupBy(key).agg(F.aggregate(listed.cast("array<struct<o:int,i:bigint,c:bigint>>"), start, step)["kept"].alias("kept"))
    return packed.select(key, F.explode("kept").alias("k")).select(key, F.col("k.o").alias(order), F.col("k.i").alias(item), F.col("k.c").alias(cost))


def r16_greedy_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in rank order that fit into 700 tokens, skipping those that don't."""
    docs = records(spark, sf_dir)
    hits = top(bm25(spark, docs, prompts(spark, sf_dir))).join(docs.select("id", text.tokens_estimate(F.col("body")).alias("cost")), "id")
    return greedy_pack(hits, "prompt_id", "rank", "cost", "id", 700)


def r24_all_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each prompt, over all records: the summed rarity of all its words of three characters or more that a record holds anywhere in its folded text.

    A term lies within one run of letters, digits and underscores: the distinct runs meet the terms by three characters, and records meet both by run.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.fold(F.coalesce("text", F.lit(""))).alias("folded"))
    terms = F.array_distinct(F.transform(text.words(F.col("prompt")), text.fts_term))
    asked = prompts(spark, sf_dir).select("prompt_id", F.explode(terms).alias("term")).where(F.length("term") >= 3).distinct()
    runs = docs.select("id", F.explode(F.array_distinct(F.split("folded", r"[^\p{L}\p{N}_]+"))).alias("run")).where(F.length("run") >= 3)
    starts = F.transform(F.sequence(F.lit(1), F.length("run") - 2), lambda i: F.substring(F.col("run"), i, F.lit(3)))
    three = runs.select("run").distinct().select("run", F.explode(F.array_distinct(starts)).alias("three"))
    words = asked.select("term").distinct().withColumn("three", F.substring("term", 1, 3))
    within = three.join(words, "three").where(F.col("run").contains(F.col("term"))).select("run", "term")
    held = runs.join(within, "run").select("id", "term").distinct()
    total = F.broadcast(docs.agg(F.count("*").alias("n")))
    d = held.groupBy("term").agg(F.count("*").alias("d")).join(total).select("term", F.round(F.log((F.col("n") + 1) / (F.col("d") + 1)), 6).alias("rarity"))
    scored = held.join(d, "term").join(asked, "term").groupBy("prompt_id", "id").agg(F.round(F.sum("rarity"), 6).alias("score"))
    best = Window.partitionBy("prompt_id").orderBy(F.desc("score"), F.desc("id"))
    return scored.withColumn("rank", F.row_number().over(best)).where("rank <= 20").select("prompt_id", "rank", "id", "score")


def r3_adjacent_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 for prompts whose words are joined by underscores, two by two: what holds them side by side."""
    w = text.words(F.col("prompt"))
    two = lambda i: F.concat_ws("_", F.get(w, F.lit(i)), F.get(w, F.lit(i + 1)))
    asked = prompts(spark, sf_dir).select("prompt_id", F.concat_ws(" ", *(two(i) for i in range(0, 12, 2)), F.get(w, F.lit(12))).alias("prompt"))
    return top(bm25(spark, records(spark, sf_dir), asked)).select("prompt_id", "rank", "id", "score", "matched")


def r2_stemmed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As r5, by stems."""
    return top(search(spark, records(spark, sf_dir), prompts(spark, sf_dir), stem=True)[0]).select("prompt_id", "rank", "id", "score", "matched")


def r26_spanish_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each prompt's words in another number, which the corpus doesn't hold for the most part, and the forms that it does hold."""
    asked = prompt_terms(prompts(spark, sf_dir)).select("prompt_id", F.concat("term", F.lit("as")).alias("term"))
    vocabulary = saved(spark, token_rows(records(spark, sf_dir)).select("term").where("term <> ''").distinct(), "vocabulary")
    return expanded(asked, vocabulary)


def r18_best_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each prompt's best result: the window of 200 characters from the start or a line start with most distinct prompt terms, the first such."""
    docs, asked = records(spark, sf_dir), prompts(spark, sf_dir)
    best = top(bm25(spark, docs, asked), 1).select("prompt_id", "id").join(docs.select("id", "body"), "id")
    terms = prompt_terms(asked).groupBy("prompt_id").agg(F.collect_set("term").alias("terms"))
    lines = F.split("body", "\n")
    starts = F.transform(F.sequence(F.lit(1), F.size(lines)), lambda i: F.length(F.array_join(F.slice(lines, F.lit(1), i - 1), "\n")) + F.when(i > 1, 2).otherwise(1))
    at = best.join(terms, "prompt_id").select("prompt_id", "id", "terms", "body", F.explode(starts).alias("start"))
    window = F.array_distinct(text.index_tokens(F.substring("body", F.col("start"), F.lit(200))))
    held = at.select("prompt_id", "id", "start", F.size(F.array_intersect(window, "terms")).alias("held"))
    first = Window.partitionBy("prompt_id").orderBy(F.desc("held"), "start")
    return held.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("prompt_id", "id", F.col("start").cast("bigint").alias("start"), F.col("held").cast("bigint").alias("held"))


QUERIES = {
    f.__name__: f
    for f in (r5_bm25_topk, r4_term_selection, r9_relative_floor, r10_absolute_floor, r14_rank_fusion, r19_prefix_budget, r16_greedy_budget, r24_all_words, r3_adjacent_terms, r2_stemmed_topk, r26_spanish_forms, r18_best_passage)
}

_COSTS = "costs AS (SELECT b.*, CAST(ceil(length(body) / 3.0) AS BIGINT) AS t FROM best b JOIN docs USING (id))"

_EVERY = _sql(
    """SELECT prompt_id, CAST(rank AS INTEGER) AS rank, id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, id DESC) AS rank FROM (
    SELECT prompt_id, id, round(sum(round(ln((n + 1) / (d + 1)), 6)), 6) AS score FROM held JOIN (SELECT term, count(*) AS d FROM held GROUP BY term) USING (term) JOIN every USING (term), whole GROUP BY 1, 2))
WHERE rank <= 20""",
    f""",
every AS (SELECT DISTINCT prompt_id, term FROM raw_terms WHERE length(term) >= 3),
folded AS MATERIALIZED (SELECT id, {duck.fold('body')} AS body FROM docs),
held AS MATERIALIZED (SELECT id, term FROM folded JOIN (SELECT DISTINCT term FROM every) ON contains(body, term))""",
)

# terms of several tokens: their occurrences are added to the postings, so that all that follows is as for one token
_ADJACENT = ("SELECT item_id AS prompt_id, array_to_string(list_filter(list_transform(range(6), lambda i: array_to_string(w[2 * i + 1:2 * i + 2], '_')) || [w[13]], lambda x: x IS NOT NULL), ' ') AS text "
             "FROM (SELECT item_id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS w FROM benchmark)")
_FIELDS = "UNION ALL ".join(f"SELECT id, {duck.index_tokens(c)} AS t, {w}::DOUBLE AS w FROM docs " for c, w in WEIGHTS.items())
_SEVERAL = f"""several AS (SELECT DISTINCT term, {duck.index_tokens('term')} AS parts FROM raw_terms WHERE contains(term, '_')),
fields AS (SELECT id, t, w, unnest(range(1, len(t) + 1)) AS i FROM ({_FIELDS})),
posts AS (SELECT id, term, sum(w) AS f FROM toks GROUP BY ALL
  UNION ALL SELECT id, term, sum(w) FROM fields JOIN several ON t[i] = parts[1] AND t[i:i + len(parts) - 1] = parts GROUP BY ALL),"""

ORACLES = {
    "r3_adjacent_terms": "",
    "r5_bm25_topk": _sql("SELECT prompt_id, rank, id, score, matched FROM best"),
    "r4_term_selection": _sql("SELECT prompt_id, term, df, idf, CAST(rn AS INTEGER) AS rn FROM chosen"),
    "r9_relative_floor": _sql(
        """SELECT prompt_id, rank, id, score, is_newest FROM (
  SELECT *, min(score) OVER w AS top_score, id = max(id) OVER w AND max(id) OVER w > max(CASE WHEN rank = 1 THEN id END) OVER w AS is_newest FROM best WINDOW w AS (PARTITION BY prompt_id))
WHERE score <= top_score * 0.5 OR is_newest"""
    ),
    "r10_absolute_floor": _sql(
        "SELECT prompt_id, id, matched, need FROM best JOIN (SELECT prompt_id, CAST(greatest(1, ceil(count(*) / 3.0)) AS BIGINT) AS need FROM chosen GROUP BY 1) USING (prompt_id) WHERE matched >= need"
    ),
    "r14_rank_fusion": _sql(
        """SELECT prompt_id, id, round(sum(1 / (60.0::DOUBLE + rank)), 9) AS fused FROM (
  SELECT prompt_id, id, rank FROM best UNION ALL SELECT prompt_id, id, row_number() OVER (PARTITION BY prompt_id ORDER BY id DESC) FROM best) GROUP BY 1, 2"""
    ),
    "r19_prefix_budget": _sql(
        "SELECT prompt_id, rank, id, cost, used FROM (SELECT *, CAST(sum(cost) OVER (PARTITION BY prompt_id ORDER BY rank) AS BIGINT) AS used FROM (SELECT *, least(t, 200) AS cost FROM costs)) WHERE used <= 700",
        ", " + _COSTS,
    ),
    "r16_greedy_budget": _sql(
        "SELECT prompt_id, rank, id, t AS cost FROM walk WHERE taken",
        ", " + _COSTS + """,
walk AS (
  SELECT prompt_id, rank, id, t, CASE WHEN t <= 700 THEN t ELSE 0 END AS used, t <= 700 AS taken FROM costs WHERE rank = 1
  UNION ALL
  SELECT c.prompt_id, c.rank, c.id, c.t, CASE WHEN w.used + c.t <= 700 THEN w.used + c.t ELSE w.used END, w.used + c.t <= 700
  FROM walk w JOIN costs c ON c.prompt_id = w.prompt_id AND c.rank = w.rank + 1)""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
    "r24_all_words": _EVERY,
    "r18_best_passage": _sql(
        """SELECT prompt_id, id, start, held FROM (
  SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY held DESC, start) AS k FROM (
    SELECT prompt_id, id, start, CAST(len(list_intersect(list_distinct(""" + duck.index_tokens("substr(body, start, 200)") + """), terms)) AS BIGINT) AS held FROM starts)) WHERE k = 1""",
        """,
bests AS (SELECT b.prompt_id, b.id, body, t.terms FROM best b JOIN docs USING (id) JOIN (SELECT prompt_id, list(term) AS terms FROM terms GROUP BY 1) t USING (prompt_id) WHERE rank = 1),
starts AS (SELECT prompt_id, id, body, terms, CAST(unnest(list_transform(range(1, len(string_split(body, chr(10))) + 1), lambda i: length(array_to_string(string_split(body, chr(10))[1:i - 1], chr(10))) + CASE WHEN i > 1 THEN 2 ELSE 1 END)) AS BIGINT) AS start FROM bests)""",
    ),
}

_PLAIN_POSTS = "posts AS (SELECT id, term, sum(w) AS f FROM toks GROUP BY ALL),"
_RAW = _BASE[_BASE.index("raw_terms AS") : _BASE.index("terms AS (SELECT DISTINCT")]
_R3 = _BASE.replace(_RAW, "").replace(_PLAIN_POSTS, _RAW + _SEVERAL).replace("PROMPTS", _ADJACENT)
ORACLES["r3_adjacent_terms"] = f"WITH {_R3}\nSELECT prompt_id, rank, id, score, matched FROM best"
ORACLES["r26_spanish_forms"] = _sql(
    "SELECT prompt_id, term, form FROM missing JOIN forms USING (stem) WHERE n <= 6",
    f""",
vocabulary AS (SELECT DISTINCT term FROM posts),
more AS (SELECT prompt_id, term || 'as' AS term FROM terms),
missing AS (SELECT prompt_id, term, {stems.spanish_stem_sql('term')} AS stem FROM more WHERE term NOT IN (SELECT term FROM vocabulary)),
forms AS (SELECT term AS form, stem, row_number() OVER (PARTITION BY stem ORDER BY term) AS n FROM (SELECT term, {stems.spanish_stem_sql('term')} AS stem FROM vocabulary) WHERE stem IS NOT NULL)""",
)
