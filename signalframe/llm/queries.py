"""The registered corpus queries, with the SQL they are checked against where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, contamination, lm_scoring, mixing, near_dups, packing, periodicity, repeats, repetition, secret_scan, text, token_counts, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Host and path rules of the URL query.
URL_RULES = [url_filter.Rule.parse(v, t) for v, t in (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))]
#: Sites whose crawled URLs make the list of the URL query.
LISTED_SITES = r"(?:^|\.)(?:ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\."


@query("op1_url_filter", rf"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(?:www|m)\.', '') || regexp_replace(path, '(?:\.html)?/*$', '') END AS key,
    CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parts),
listed AS (SELECT DISTINCT key FROM ruled WHERE regexp_matches(host, '{LISTED_SITES}'))
SELECT page_id, host, path, rule, rule IS NULL AND key IS NOT NULL AND key IN (SELECT key FROM listed WHERE key IS NOT NULL) AS listed,
  CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN key IS NOT NULL AND key IN (SELECT key FROM listed WHERE key IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
""")
def op1_url_filter(spark, sf_dir):
    """Verdict on every page's URL: fixed rules, then the list of URLs crawled from listed sites."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(url_filter.host_of(F.col("url")).rlike(LISTED_SITES)).select("url")
    return url_filter.judge(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "listed", "verdict")


@query("op2_lm_scoring", r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
goals AS (SELECT DISTINCT doc_id, 1 AS goal FROM labels WHERE quality = 1 AND doc_id IS NOT NULL),
t AS (SELECT doc_id, unnest(w) AS raw, unnest(range(1, len(w) + 1)) AS i FROM d),
v AS (SELECT raw FROM t GROUP BY raw),
k AS (SELECT t.doc_id, i, coalesce(v.raw, '') AS w, coalesce(goal, 0) AS goal FROM t LEFT JOIN v USING (raw) LEFT JOIN goals USING (doc_id)),
b AS (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM k),
size AS (SELECT count(*) AS n FROM v),
sides AS (SELECT count(*) AS nb, coalesce(sum(goal), 0) AS nt FROM k),
u AS (
  SELECT w, cb, ct, (cb + 1) / (nb + size.n + 1) AS pb, (ct + 1) / (nt + size.n + 1) AS pt
  FROM (SELECT w, CAST(count(*) AS DOUBLE) AS cb, CAST(sum(goal) AS DOUBLE) AS ct FROM k GROUP BY w), sides, size),
g AS (
  SELECT c, w, CAST(count(*) AS DOUBLE) AS cb, CAST(sum(goal) AS DOUBLE) AS ct FROM b
  WHERE c <> '' AND w <> '' GROUP BY c, w),
units AS (
  SELECT b.doc_id, CAST(CASE
    WHEN b.c IS NULL THEN floor((log2(u.pb) - log2(u.pt)) * 1e6 + 0.5)
    WHEN g.cb IS NULL THEN floor((log2(u.pb) - log2(u.pt)) * 1e6 + 0.5) + floor((log2(x.ct + 200) - log2(x.cb + 200)) * 1e6 + 0.5)
    ELSE floor((log2((g.cb + 200 * u.pb) / (x.cb + 200)) - log2((g.ct + 200 * u.pt) / (x.ct + 200))) * 1e6 + 0.5) END AS BIGINT) AS units
  FROM b JOIN u ON b.w = u.w LEFT JOIN u x ON b.c = x.w LEFT JOIN g ON b.c = g.c AND b.w = g.w)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_tokens, coalesce(s.units, 0) AS loss_units,
  CASE WHEN len(d.w) > 0 THEN CAST(s.units AS DOUBLE) / len(d.w) / 1e6 END AS score
FROM d LEFT JOIN (SELECT doc_id, CAST(sum(units) AS BIGINT) AS units FROM units GROUP BY doc_id) s USING (doc_id)
""")
def op2_lm_scoring(spark, sf_dir):
    """Cross-entropy difference of every document; the target are the documents labelled as good."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_scoring.with_score(docs, good).select("doc_id", "lm.*")


@query("op3_minhash_near_dedup", r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
pairs AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, e.b FROM reach r JOIN pairs e ON r.b = e.a),
roots AS (SELECT a, least(a, min(b)) AS root FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(root, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN roots ON roots.a = d.doc_id
""")
def op3_minhash_near_dedup(spark, sf_dir):
    """Groups of near copies among all documents: three-word shingles, similarity of at least 0.85."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dups.groups(docs, shingle=3, up=85, down=100)


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark, sf_dir):
    """Every document in bins of 2048 words; exact copies and documents of one source are kept apart."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return packing.pack(docs, packing.word_count(F.col("text")), cluster=F.col("text"))


@query("op5_secret_scan")
def op5_secret_scan(spark, sf_dir):
    """Secret spans of every document."""
    docs = secret_scan.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), name="s")
    number = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return docs.select("doc_id", *map(number, secret_scan.KINDS), secret_scan.base_digest(F.col("s")).alias("base_sha256"),
                       secret_scan.span_text(F.col("s")).alias("spans"))


@query("op6_suffix_dedup", r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
places AS (
  SELECT doc_id, s, md5(b[s:s + 399]) AS h
  FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 398)) AS s FROM d WHERE octet_length(b) >= 400)),
hot AS (SELECT h FROM places GROUP BY h HAVING count(*) > 1),
starts AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM places JOIN hot USING (h)),
runs AS (SELECT doc_id, s, sum(CASE WHEN p IS NULL OR s > p + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM starts),
spans AS (SELECT doc_id, run, min(s) AS a, max(s) + 400 AS e FROM runs GROUP BY doc_id, run),
sums AS (SELECT doc_id, sum(e - a) AS removed, count(*) AS n FROM spans GROUP BY doc_id),
cuts AS (
  SELECT doc_id, a AS e, lag(e, 1, 1) OVER (PARTITION BY doc_id ORDER BY a) AS a FROM spans
  UNION ALL SELECT doc_id, octet_length(b) + 1, max(e) FROM spans JOIN d USING (doc_id) GROUP BY doc_id, b),
kept AS (SELECT doc_id, string_agg(hex(b[a:e - 1]), '' ORDER BY a) AS k FROM cuts JOIN d USING (doc_id) WHERE e > a GROUP BY doc_id)
SELECT d.doc_id, octet_length(b) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, n IS NOT NULL AS changed,
  CASE WHEN n IS NULL THEN sha256(b) ELSE sha256(unhex(coalesce(k, ''))) END AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
""")
def op6_suffix_dedup(spark, sf_dir):
    """Bytes of every document inside passages of 400 bytes that occur elsewhere too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lost = repeats.removals(docs).select("row", "n_kept", F.size("spans").cast("long").alias("spans"), F.col("kept_sha256").alias("sha"))
    body = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.row_key("doc_id", "text").alias("row"), F.octet_length(body).cast("long").alias("n_bytes"),
                       F.sha2(body, 256).alias("whole"))
    out = rows.join(lost, "row", "left")
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.coalesce("n_kept", "n_bytes")).alias("n_removed"),
                      F.coalesce("spans", F.lit(0).cast("long")).alias("n_spans"), F.col("spans").isNotNull().alias("changed"), F.coalesce("sha", "whole").alias("kept_sha256"))


@query("op7_toxicity")
def op7_toxicity(spark, sf_dir):
    """Toxicity of every document; labels of a third of the ids are never looked at."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels"), ~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.toxicity(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query("op8_benchmark_decontamination", r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + 12), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM iw WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lengths WHERE len(w) >= n)),
hits AS (SELECT p.doc_id, p.n, p.i, x.item_id FROM places p JOIN windows x ON p.n = x.n AND p.win = x.win),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM dw d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op8_benchmark_decontamination(spark, sf_dir):
    """Words of every document inside windows of test items."""
    docs = contamination.with_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), name="c")
    c = F.col("c")
    return docs.select("doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"),
                       F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"), contamination.is_contaminated(c).alias("contaminated"))


@query("op9_quality_rules", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM l),
c AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS chars FROM w GROUP BY doc_id),
grams AS (
  SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM l, (VALUES (3), (5), (6), (7), (8), (9), (10)) v(n) WHERE len(ws) >= n)),
rep AS (SELECT doc_id, n, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, n, g) AS k FROM grams) WHERE k > 1),
inside AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS i FROM rep),
cov AS (SELECT doc_id, n, count(*) AS words, sum(length(w)) AS chars FROM inside JOIN w USING (doc_id, i) GROUP BY doc_id, n),
lines AS (SELECT doc_id, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(t, chr(10)) AS x FROM d)),
again AS (SELECT doc_id, line FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1),
dup AS (SELECT doc_id, count(*) AS n, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS chars FROM again GROUP BY doc_id),
bad AS (SELECT DISTINCT doc_id FROM cov JOIN c USING (doc_id) JOIN (VALUES (5, 15), (6, 14), (7, 13), (8, 12), (9, 11), (10, 10)) m(n, most) USING (n)
        WHERE 100 * cov.chars > most * c.chars AND cov.chars > 240),
f AS (
  SELECT d.doc_id, t, coalesce(n_words, 0) AS n_words, CAST(coalesce(c.chars, 0) AS BIGINT) AS word_chars, coalesce(dup.n, 0) AS n_dup_lines,
    coalesce(dup.chars, 0) AS dup_chars, coalesce(cov.words, 0) AS n_repeat_words, bad.doc_id IS NOT NULL AS bad
  FROM d LEFT JOIN c USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN cov ON cov.doc_id = d.doc_id AND cov.n = 3 LEFT JOIN bad ON bad.doc_id = d.doc_id)
SELECT doc_id, n_words, word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND (100 * dup_chars <= 20 * word_chars OR dup_chars <= 120) AND NOT bad AS kept
FROM f
""")
def op9_quality_rules(spark, sf_dir):
    """Repetition counts and verdict of every document."""
    docs = repetition.with_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), name="q")
    return docs.select("doc_id", *(F.col(f"q.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


@query("op10_token_counts")
def op10_token_counts(spark, sf_dir):
    """Token counts of every document."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = token_counts.with_token_count(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens",
                       (F.col("n_tokens") > 1024).alias("over_limit"))


@query("op11_periodic_runs", r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) AS h
  FROM documents),
p AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS e FROM d),
l AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // e) + 1] END) ELSE w END AS w FROM p),
g AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i + 1, i + 3), ' ') AS g FROM (SELECT doc_id, n, w, unnest(range(n - 2)) AS i FROM l WHERE n >= 6)),
same AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.g = y.g AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same),
every AS (
  SELECT doc_id, min(i) AS start, count(*) + 2 + q AS length, q AS period FROM islands GROUP BY doc_id, q, island HAVING count(*) + 2 + q >= greatest(6, 4 * q)),
runs AS (
  SELECT * FROM every r WHERE NOT EXISTS (
    SELECT 1 FROM every o WHERE o.doc_id = r.doc_id AND o.period < r.period AND o.start <= r.start AND o.start + o.length >= r.start + r.length)),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
text AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(range(n)) AS i FROM l) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT l.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(text.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM l LEFT JOIN best USING (doc_id) LEFT JOIN text USING (doc_id) LEFT JOIN kept USING (doc_id)
""")
def op11_periodic_runs(spark, sf_dir):
    """Runs of at least four periods in every document; a tenth of the documents is made periodic first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodicity.with_runs(docs.withColumn("text", made_periodic(F.col("doc_id"), F.col("text"))), name="r")
    runs, best = F.col("r.runs"), periodicity.longest(F.col("r.runs"))
    return found.select("doc_id", F.size(runs).cast("long").alias("n_runs"), *(best[c].alias(c) for c in ("start", "length", "period")),
                        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
                        F.sha2(periodicity.run_text(runs), 256).alias("runs_sha256"), F.sha2(F.col("r.collapsed"), 256).alias("collapsed_sha256"))


def made_periodic(doc_id, body):
    """Of every tenth document, by the checksum of its id, the words from a place on repeat; other texts stay as they are."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    blank = r"[\x20\x09-\x0D]+"

    def repeated(words):
        n = F.size(words).cast("long")
        first = F.pmod(g, n)
        period = 1 + F.floor((n - first) / (3 + F.pmod(g, F.lit(8))))
        unit = F.slice(words, (first + 1).cast("int"), period.cast("int"))
        tail = F.slice(F.flatten(F.array_repeat(unit, (F.floor((n - first) / period) + 1).cast("int"))), F.lit(1), (n - first).cast("int"))
        return F.array_join(F.concat(F.slice(words, F.lit(1), first.cast("int")), tail), " ")

    # A list of one, so that the words are split once.
    words = F.array(F.split(F.regexp_replace(body, rf"\A{blank}|{blank}\z", ""), blank))
    return F.when((F.pmod(h, F.lit(10)) == 0) & body.rlike(r"[^\x20\x09-\x0D]"), F.get(F.transform(words, repeated), F.lit(0))).otherwise(body)


def _cluster_sql(rounds: int) -> str:
    """The rounds one after another: assignments ``a`` and centroids ``c``."""
    def assigned(r: int) -> str:
        return f"""a{r} AS MATERIALIZED (
  SELECT u, any_value(vec_id) AS vec_id, any_value(q) AS q, min(struct_pack(d := d, k := k)) AS best
  FROM (SELECT u, vec_id, v.q, k, list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{r} c) GROUP BY u)"""

    def moved(r: int) -> str:
        return f"""c{r + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN (
    SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q
    FROM (SELECT best.k AS k, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT best, unnest(q) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY ALL) GROUP BY k) m USING (k))"""

    steps = [part for r in range(rounds) for part in (assigned(r), moved(r))]
    return f"""WITH v AS MATERIALIZED (
  SELECT vec_id, embedding, row_number() OVER () AS u, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), embedding) - 1 AS k, q FROM v WHERE vec_id IS NOT NULL QUALIFY k < 8),
{"," .join(steps)}, {assigned(rounds)}
SELECT vec_id, CAST(best.k AS INT) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.q, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c{rounds}.k = best.k"""


@query("op12_centroid_clusters", _cluster_sql(10))
def op12_centroid_clusters(spark, sf_dir):
    """Eight clusters of all vectors after ten rounds."""
    found = clustering.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", clustering.centroid_digest(F.col("centroid")).alias("centroid_sha256"))


@query("op13_source_mix", r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, 2 * source_size AS bound, CASE k % 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS weight FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY bound / weight, k) AS r FROM w),
c AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5) - CAST(coalesce(sum(bound) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS open,
    CAST(sum(weight) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS rest FROM r),
f AS (SELECT r AS least_r, open, rest FROM c WHERE weight * (open / rest) <= bound ORDER BY r LIMIT 1),
t AS (SELECT c.source, source_size, CASE WHEN least_r IS NULL OR r < least_r THEN CAST(bound AS DOUBLE) ELSE weight * f.open / f.rest END AS target FROM c LEFT JOIN f ON true),
x AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
    CAST(sum(size) OVER (PARTITION BY d.source ORDER BY md5('13:' || doc_id), doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END AS taken
FROM x
""")
def op13_source_mix(spark, sf_dir):
    """Words that a mix of all sources takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, packing.word_count(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken")
