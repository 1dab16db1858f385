"""Queries on text segments, parsing and text scalars."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronoloom.functions import text as X
from chronoloom.plans.catalog import query
from chronoloom.plans.frames import CURVE_SQL, DURATION_SQL, curve, duration, read

_SEGMENTS = "seg AS (SELECT conv_id, turn, turn * 10.0 AS start, turn * 10.0 + 10.0 AS \"end\", list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda w: w <> '') AS ws FROM conversations)"


def _segments(spark, sf):
    c = read(spark, sf, "conversations")
    return c.select("conv_id", "turn", (F.col("turn") * 10.0).alias("start"), (F.col("turn") * 10.0 + 10).alias("end"), X.words(F.col("text")).alias("ws"))


@query(
    "q_window_text_slice",
    f"""WITH {_SEGMENTS}, w AS (SELECT *, unnest(range(floor(start / 7)::BIGINT, ceil("end" / 7)::BIGINT)) AS w FROM seg),
    x AS (SELECT conv_id, w, turn, ws, round_even(len(ws) * (greatest(w * 7, start) - start) / 10, 0)::INT AS a, round_even(len(ws) * (least(w * 7 + 7, "end") - start) / 10, 0)::INT AS b FROM w)
    SELECT conv_id, w, string_agg(array_to_string(list_slice(ws, a + 1, b), ' '), ' ' ORDER BY turn) AS text FROM x WHERE b > a GROUP BY conv_id, w""",
)
def window_text_slice(spark, sf):
    """Words of the segments that overlap a window of seven seconds, in proportion to the overlap."""
    s = _segments(spark, sf).withColumn("w", F.explode(F.sequence(F.floor(F.col("start") / 7), F.ceil(F.col("end") / 7) - 1)))
    cut = X.slice_by_share(F.col("ws"), F.col("w") * 7.0, F.col("w") * 7.0 + 7, F.col("start"), F.col("end"))
    parts = s.select("conv_id", "w", "turn", cut.alias("ws")).where("size(ws) > 0")
    lists = parts.groupBy("conv_id", "w").agg(F.array_sort(F.collect_list(F.struct("turn", F.array_join("ws", " ").alias("t")))).alias("l"))
    return lists.select("conv_id", "w", F.array_join(F.transform("l", lambda x: x["t"]), " ").alias("text"))


@query("q_fill_times", f"WITH {CURVE_SQL}, c AS (SELECT gid, idx, CASE WHEN idx % 3 = 0 THEN t END AS start FROM curve) SELECT gid, idx, round(coalesce(start, max(start) OVER (PARTITION BY gid ORDER BY idx ROWS UNBOUNDED PRECEDING), 0), 6) AS prev_end, round(coalesce(start, min(start) OVER (PARTITION BY gid ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), {DURATION_SQL}), 6) AS next_start FROM c")
def fill_times(spark, sf):
    """Missing times by two policies: the last known one, or the next known one, else the duration."""
    o = W.partitionBy("gid").orderBy("idx")
    start = F.when(F.col("idx") % 3 == 0, F.col("t"))
    c = curve(spark, sf).select("gid", "idx", start.alias("start"))
    return c.select("gid", "idx", F.round(F.coalesce("start", F.max("start").over(o.rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0)), 6).alias("prev_end"), F.round(F.coalesce("start", F.first("start", ignorenulls=True).over(o.rowsBetween(0, W.unboundedFollowing)), F.lit(duration(spark, sf))), 6).alias("next_start"))


@query(
    "q_text_degeneracy",
    r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    p AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(replace(text, chr(10), ' '), '([。，.,])', '\1|', 'g'), '|'), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))), lambda x: x <> '')) AS c FROM d),
    k AS (SELECT doc_id, c, count(*) AS n FROM p GROUP BY ALL), l AS (SELECT doc_id, sum(n) AS n, sum(n * length(c)) AS total, coalesce(sum(n * length(c)) FILTER (n > 1), 0) AS again FROM k GROUP BY doc_id),
    h AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM d WHERE text <> ''),
    g AS (SELECT doc_id, ch, i - row_number() OVER (PARTITION BY doc_id, ch ORDER BY i) AS island FROM h),
    m AS (SELECT doc_id, max(n) AS run, count(DISTINCT ch) AS chars FROM (SELECT doc_id, ch, island, count(*) AS n FROM g GROUP BY ALL) GROUP BY doc_id)
    SELECT doc_id, coalesce(l.n, 0)::BIGINT AS n_clauses, CASE WHEN l.n >= 2 THEN round(again / greatest(total, 1), 9) END AS loop_frac, coalesce(run, 0) AS max_char_run, round(chars / length(text), 9) AS distinct_char_ratio,
      regexp_matches(text, '[\[(♪]|《音|音乐|掌声|[Mm]usic|Applause|字幕|订阅|点赞') AS bracket_tag FROM d LEFT JOIN l USING (doc_id) LEFT JOIN m USING (doc_id)""",
)
def text_degeneracy(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", X.degeneracy(F.col("text")).alias("d"))
    return d.select("doc_id", "d.n_clauses", F.round("d.loop_frac", 9).alias("loop_frac"), "d.max_char_run", F.round("d.distinct_char_ratio", 9).alias("distinct_char_ratio"), "d.bracket_tag")


@query("q_hedge_count", "SELECT doc_id, len(regexp_extract_all(lower(text), '\\b(that|this|with)\\b')) AS n, regexp_matches(lower(text), 'licen[sc]e|copyright') AS cue FROM documents")
def hedge_count(spark, sf):
    t = F.lower("text")
    return read(spark, sf, "documents").select("doc_id", X.count_matches(t, r"\b(that|this|with)\b").alias("n"), t.rlike("licen[sc]e|copyright").alias("cue"))


@query("q_script_profile", "SELECT doc_id, len(regexp_extract_all(text, '\\p{L}')) AS letters, len(regexp_extract_all(text, '[0-9]')) AS digits, len(regexp_extract_all(text, '[^\\x00-\\x7F]')) AS non_ascii, len(regexp_extract_all(text, '\\p{Han}')) AS han FROM documents")
def script_profile(spark, sf):
    n = lambda p, name: X.count_matches(F.col("text"), p).alias(name)
    return read(spark, sf, "documents").select("doc_id", n(r"\p{L}", "letters"), n("[0-9]", "digits"), n(r"[^\x00-\x7F]", "non_ascii"), n(r"\p{IsHan}", "han"))


@query("q_length_bins", "SELECT CASE WHEN n_chars < 200 THEN 'short' WHEN n_chars < 1000 THEN 'medium' WHEN n_chars < 5000 THEN 'long' ELSE 'huge' END AS bin, count(*) AS n FROM documents GROUP BY 1")
def length_bins(spark, sf):
    n = F.col("n_chars")
    return read(spark, sf, "documents").groupBy(F.when(n < 200, "short").when(n < 1000, "medium").when(n < 5000, "long").otherwise("huge").alias("bin")).agg(F.count("*").alias("n"))


@query("q_parse_clock", "WITH c AS (SELECT event_id, ((event_id * 37) % 90000) AS v FROM events) SELECT event_id, v::BIGINT AS seconds FROM c")
def parse_clock(spark, sf):
    v = F.col("event_id") * 37 % 90000
    clock = F.when(v >= 3600, F.format_string("%d:%02d:%02d.7", F.floor(v / 3600), F.floor(v / 60) % 60, v % 60)).when(v >= 60, F.format_string("%d:%02d", F.floor(v / 60), v % 60)).otherwise(v.cast("string"))
    return read(spark, sf, "events").select("event_id", X.parse_clock(clock).alias("seconds"))


@query("q_parse_spans", "SELECT event_id, round(least(value, 50), 2) AS start, round(greatest(value, 50), 2) AS \"end\" FROM events")
def parse_spans(spark, sf):
    cell = F.concat(F.lit("[["), F.round("value", 2).cast("string"), F.lit(", 50]]"))
    e = read(spark, sf, "events").select("event_id", F.explode(X.parse_spans(cell)).alias("s"))
    return e.select("event_id", F.round("s.start", 2).alias("start"), F.round("s.end", 2).alias("end"))


@query("q_json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf):
    fenced = F.concat(F.lit(" ```json\n"), F.col("props"), F.lit("\n```"))
    return read(spark, sf, "events").select("event_id", F.get_json_object(X.clean_json(fenced), "$.k").cast("long").alias("k"))


@query(
    "q_parse_score",
    """WITH e AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN (event_id % 10) / 10 WHEN 1 THEN (event_id % 100) / 100 WHEN 2 THEN event_id % 13 WHEN 3 THEN (event_id % 170) - 20 END AS score, CASE event_id % 6 WHEN 0 THEN 'bare_float' WHEN 1 THEN 'sentence' WHEN 2 THEN 'sentence' WHEN 3 THEN 'trailing_number' WHEN 4 THEN 'unparsed' ELSE 'empty' END AS status FROM events)
    SELECT event_id, score::DOUBLE AS score, status, CASE WHEN score < 0 THEN 0 WHEN score <= 1 THEN score WHEN score <= 10 THEN score / 10 WHEN score <= 100 THEN score / 100 WHEN score > 100 THEN 1 END AS value,
      CASE WHEN score IS NULL THEN 'none' WHEN score < 0 THEN 'clamped_low' WHEN score <= 1 THEN 'in_range' WHEN score <= 10 THEN 'div10' WHEN score <= 100 THEN 'div100' ELSE 'clamped_high' END AS rule FROM e""",
)
def parse_score(spark, sf):
    i = F.col("event_id")
    forms = [
        F.concat(F.lit(" "), (i % 10 / 10).cast("string"), F.lit("\n")),
        F.concat(F.lit("The score is 3, no: therefore, the final score is "), (i % 100 / 100).cast("string"), F.lit(".")),
        F.concat(F.lit("Score: 99? Final score = "), (i % 13).cast("string"), F.lit(" points")),
        F.concat(F.lit("I would say "), (i % 170 - 20).cast("string"), F.lit(". ")),
        F.lit("no idea"),
        F.lit(" "),
    ]
    p = read(spark, sf, "events").select("event_id", X.parse_score(F.element_at(F.array(*forms), (i % 6 + 1).cast("int"))).alias("p"))
    return p.select("event_id", "p.score", "p.status", X.normalise_score(F.col("p.score")).alias("n")).select("event_id", "score", "status", "n.value", "n.rule")


@query("q_token_logodds", "WITH l AS (SELECT event_id, -value / 10 AS a, -value / 20 - 1 AS b FROM events), p AS (SELECT *, exp(a) AS p, exp(b) AS q FROM l) SELECT event_id, round(CASE WHEN event_id % 3 = 0 THEN ln(exp(a) + exp(a - 1)) - b ELSE ln(exp(a) + exp(a - 1)) - (a - 1) END, 6) AS z, CASE WHEN event_id % 3 = 0 THEN 'ok' ELSE 'bounded' END AS status, round((p * (3 * p + 9 * q) / (10 * (p + q)) + q * 1 + p * q * 0.7) / (p + q + p * q), 6) AS score FROM p")
def token_logodds(spark, sf):
    a, b = -F.col("value") / 10, -F.col("value") / 20 - 1
    yes = F.create_map(F.lit("Yes"), a, F.lit(" yes"), a - 1)
    votes = F.when(F.col("event_id") % 3 == 0, F.map_concat(yes, F.create_map(F.lit("No"), b))).otherwise(yes)
    first, decimal = F.create_map(F.lit("0"), a, F.lit("1"), b, F.lit("7"), a + b, F.lit("x"), a), F.create_map(F.lit("3"), a, F.lit("9"), b)
    return read(spark, sf, "events").select("event_id", X.yes_no_logodds(votes).alias("v"), F.round(X.expected_score(first, decimal), 6).alias("score")).select("event_id", F.round("v.z", 6).alias("z"), "v.status", "score")


@query("q_transcript_rendering", "SELECT conv_id, string_agg(printf('[%.1f-%.1f] %s', turn * 10.0, turn * 10.0 + 10.0, role), chr(10) ORDER BY turn) AS block FROM conversations GROUP BY conv_id")
def transcript_rendering(spark, sf):
    c = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((F.col("turn") * 10.0).alias("start"), (F.col("turn") * 10.0 + 10).alias("end"), F.col("role").alias("text")))).alias("s"))
    return c.select("conv_id", X.rendered(F.col("s")).alias("block"))


@query("q_bag_cosine", "WITH w AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS w FROM conversations), c AS (SELECT conv_id, turn, w, count(*) AS n FROM w GROUP BY ALL), q AS (SELECT conv_id, turn, sqrt(sum(n * n)) AS q FROM c GROUP BY ALL), d AS (SELECT a.conv_id, a.turn, sum(a.n * b.n) AS d FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.w = b.w GROUP BY ALL) SELECT x.conv_id, x.turn, round(coalesce(d, 0) / (x.q * y.q), 6) AS cosine FROM q x JOIN q y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1 LEFT JOIN d ON d.conv_id = x.conv_id AND d.turn = x.turn")
def bag_cosine(spark, sf):
    """Cosine of the word counts of consecutive turns."""
    c = read(spark, sf, "conversations").select("conv_id", "turn", F.explode(X.words(F.col("text"))).alias("w")).groupBy("conv_id", "turn", "w").agg(F.count("*").alias("n"))
    q = c.groupBy("conv_id", "turn").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("q"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), "w", F.col("n").alias("m"))
    d = c.join(nxt, ["conv_id", "turn", "w"]).groupBy("conv_id", "turn").agg(F.sum(F.col("n") * F.col("m")).alias("d"))
    pairs = q.join(q.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("q").alias("p")), ["conv_id", "turn"]).join(d, ["conv_id", "turn"], "left")
    return pairs.select("conv_id", "turn", F.round(F.coalesce("d", F.lit(0)) / (F.col("q") * F.col("p")), 6).alias("cosine"))


@query("q_compression_ratio")
def compression_ratio(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.round(X.gzip_ratio(F.col("text")), 9).alias("ratio"))


@query("q_clause_keys")
def clause_keys(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", X.clause_key(F.col("text")).alias("k"))


@query("q_word_distance")
def word_distance(spark, sf):
    """Edit distance and common words of consecutive turns, all their words."""
    c = read(spark, sf, "conversations").select("conv_id", "turn", X.norm_words(F.col("text")).alias("ws"))
    nxt = F.lead("ws").over(W.partitionBy("conv_id").orderBy("turn"))
    d = c.withColumn("n", nxt).where("n is not null").select("conv_id", "turn", X.word_distance(F.col("ws"), F.col("n")).alias("d"))
    return d.select("conv_id", "turn", "d.edits", "d.common")


@query("q_collapse_repeats")
def collapse_repeats(spark, sf):
    c = X.collapse_repeats(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.md5(c).alias("digest"), F.size(F.split(c, " ")).alias("n"))


@query("q_text_valleys")
def text_valleys(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.array_join(X.valley_breaks(F.col("text")), ",").alias("breaks"))


@query("q_ngram_hits", "WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM documents), p AS (SELECT doc_id, unnest(list_zip(ws[:-2], ws[2:])) AS g FROM w WHERE len(ws) > 1) SELECT doc_id, count(*) AS n FROM p WHERE g[1] = 'of' AND g[2] = 'the' GROUP BY doc_id")
def ngram_hits(spark, sf):
    """Places of a word pair."""
    ws = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    d = read(spark, sf, "documents").select("doc_id", ws.alias("ws"))
    n = F.size(F.filter(F.transform("ws", lambda w, i: (w == "of") & (F.get("ws", i + 1) == "the")), lambda x: x))
    return d.select("doc_id", n.cast("long").alias("n")).where("n > 0")


@query("q_char_times", "WITH s AS (SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0, length(text) AS n FROM conversations), p AS (SELECT conv_id, unnest(range(0, total, 50)) AS c FROM (SELECT conv_id, max(c0 + n)::BIGINT AS total FROM s GROUP BY conv_id)) SELECT p.conv_id, c, round(turn * 10 + 10.0 * (c - c0) / n, 6) AS t FROM p JOIN s ON p.conv_id = s.conv_id AND c >= c0 AND c < c0 + n")
def char_times(spark, sf):
    """Times of every fiftieth character, interpolated inside its turn."""
    o = W.partitionBy("conv_id").orderBy("turn")
    s = read(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    s = s.withColumn("c0", F.coalesce(F.sum("n").over(o.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    first = F.ceil(F.col("c0") / 50).cast("long")
    last = F.ceil((F.col("c0") + F.col("n")) / 50).cast("long") - 1
    p = s.where(last >= first).select("conv_id", "turn", "n", "c0", F.explode(F.sequence(first, last)).alias("k")).withColumn("c", F.col("k") * 50)
    return p.select("conv_id", "c", F.round(F.col("turn") * 10 + 10.0 * (F.col("c") - F.col("c0")) / F.col("n"), 6).alias("t"))
