"""The operators of this subpackage as queries on the standard tables, next to their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stancewright.llm import (
    exact_dedup,
    html_extract,
    license_scan,
    line_dedup,
    mixing,
    ngram_join,
    periodic_runs,
    sp_sampling,
    spelling_variants,
    substring_dedup,
    toxicity,
    url_filter,
    vector_dedup,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function name."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Words in SQL: runs of anything but blank and the control characters 9 to 13.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def topic(text: Column) -> Column:
    """What a text is mostly about, by what it holds; tested on the whole text, in this order."""
    return (
        F.when(F.contains(text, F.lit("icense")) | F.contains(text, F.lit("icence")), "licence")
        .when(F.contains(text, F.lit("@")), "contact")
        .when(F.contains(text, F.lit(" | ")), "table")
        .otherwise("prose")
    )


def margins() -> dict[str, Column]:
    """The margins of the standard documents."""
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": topic(F.col("text"))}


# Words by which the toxic rows of the labels are told apart.
INSULTS = ["clown", "idiot", "loser", "moron", "scum"]
CONTEMPT = ["disgusting", "pathetic", "stupid", "trash", "worthless"]


def toxic_categories() -> dict[str, Column]:
    """Categories of the chain: two kinds of toxic rows, then the label itself."""
    holds = lambda words: F.col("text").rlike(rf"(?i)\b({'|'.join(words)})\b")
    return {
        "insult": (F.col("toxic") == 1) & holds(INSULTS),
        "contempt": (F.col("toxic") == 1) & holds(CONTEMPT),
        "toxic": F.col("toxic") == 1,
    }


@query(r"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM t),
k AS (SELECT doc_id, i, string_split(trim(regexp_replace(translate(
          line, chr(9) || chr(13) || chr(11) || chr(12), '    '), ' {2,}', ' ', 'g'), ' '), ' ') AS w FROM l),
m AS (SELECT doc_id, i, w, list_transform(w, lambda x:
          CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS mw FROM k WHERE w[1] <> ''),
f AS (SELECT doc_id, i, w, mw, len(w) || ' ' || array_to_string(mw[1:3], ' ') AS leaf FROM m),
big AS (SELECT leaf FROM f GROUP BY leaf HAVING count(DISTINCT doc_id) >= 5),
c AS (SELECT * FROM f SEMI JOIN big USING (leaf)),
p AS (SELECT doc_id, i, leaf, unnest(mw) AS x, unnest(range(1, len(mw) + 1)) AS pos FROM c),
n AS (SELECT leaf, pos, x, count(*) AS n FROM p WHERE x <> '<*>' GROUP BY ALL),
const AS (SELECT leaf, pos, x FROM n WHERE n >= 5),
g AS (SELECT p.doc_id, p.i, string_agg(CASE WHEN const.x IS NULL THEN '<*>' ELSE p.x END, ' ' ORDER BY p.pos) AS tpl,
             avg(CASE WHEN const.x IS NULL THEN 1 ELSE 0 END) AS wild, bool_or(const.x IS NOT NULL) AS has_const
      FROM p LEFT JOIN const ON p.leaf = const.leaf AND p.pos = const.pos AND p.x = const.x GROUP BY ALL),
ok AS (SELECT doc_id, i, tpl FROM g WHERE wild <= 0.5 AND has_const),
again AS (SELECT tpl FROM ok GROUP BY tpl HAVING count(DISTINCT doc_id) >= 5),
gone AS (SELECT doc_id, i FROM ok SEMI JOIN again USING (tpl)),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS kept, count(*) AS n
         FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - coalesce(n, 0) AS BIGINT) AS n_dropped,
       sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (doc_id)
""")
def op1_line_dedup(spark, d):
    """Lines whose template recurs in five documents or more are dropped."""
    cut = line_dedup.drop_recurring_lines(table(spark, d, "documents"), min_docs=5)
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


_RAKED = "sum(m) OVER (PARTITION BY {0})"


@query(rf"""
WITH RECURSIVE t AS (
    SELECT doc_id, coalesce(source, '<none>') AS s, coalesce(lang, '<none>') AS l,
           CASE WHEN contains(text, 'icense') OR contains(text, 'icence') THEN 'licence' WHEN contains(text, '@') THEN 'contact'
                WHEN contains(text, ' | ') THEN 'table' ELSE 'prose' END AS c, CAST(len({WORDS}) AS BIGINT) AS n FROM documents),
cell AS (SELECT s, l, c, CAST(sum(n) AS DOUBLE) AS n FROM t GROUP BY ALL),
share AS (SELECT s, l, c, n, pow(sum(n) OVER (PARTITION BY s), 0.9) AS ps, pow(sum(n) OVER (PARTITION BY l), 0.9) AS pl,
                 pow(sum(n) OVER (PARTITION BY c), 0.9) AS pc FROM cell),
target AS (SELECT s, l, c, n, (SELECT sum(n) FROM cell) AS total,
        ps / (SELECT sum(ps) FROM (SELECT s, max(ps) AS ps FROM share GROUP BY s)) AS ts,
        pl / (SELECT sum(pl) FROM (SELECT l, max(pl) AS pl FROM share GROUP BY l)) AS tl,
        pc / (SELECT sum(pc) FROM (SELECT c, max(pc) AS pc FROM share GROUP BY c)) AS tc FROM share),
r AS (SELECT 0 AS i, s, l, c, n, total, ts, tl, tc, n AS m FROM target
      UNION ALL SELECT i + 1, s, l, c, n, total, ts, tl, tc, m * tc * total / {_RAKED.format("c")}
      FROM (SELECT * REPLACE (m * tl * total / {_RAKED.format("l")} AS m)
            FROM (SELECT * REPLACE (m * ts * total / {_RAKED.format("s")} AS m) FROM r WHERE i < 80))),
w AS (SELECT s, l, c, CASE WHEN n > 0 THEN m / n ELSE 1 END AS w, n FROM r WHERE i = 80),
p AS (SELECT s, l, c, w, least(1, w / (SELECT max(w) FROM w WHERE n > 0)) AS p FROM w)
SELECT doc_id, n AS n_tokens, round(w, 6) AS weight, round(p, 6) AS probability,
       CAST('0x' || substr(md5('2:' || doc_id), 1, 12) AS BIGINT) / 281474976710656.0 < p AS kept
FROM t JOIN p USING (s, l, c)
""")
def op2_source_mixing(spark, d):
    """Documents drawn so that source, language and topic come nearer to equal shares of the tokens."""
    drawn = mixing.mix(table(spark, d, "documents"), margins(), power=0.9, seed=2)
    return drawn.withColumns({n: F.round(n, 6) for n in ("weight", "probability")})


@query()
def op3_toxicity_chain(spark, d):
    """Category probabilities of every document by a chain fitted on the labelled ones."""
    docs = table(spark, d, "documents")
    chain = toxicity.train_chain(docs, table(spark, d, "labels"), toxic_categories())
    return toxicity.score(docs, chain).withColumnRenamed("rejected", "toxic")


@query(f"""
WITH t AS (SELECT doc_id, {WORDS} AS w FROM documents),
     pos AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM t),
     win AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 34], ' ')) AS h FROM pos),
     again AS (SELECT doc_id, s FROM win
               WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
     gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS i FROM again),
     word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM t),
     left_over AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS kept
                   FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
       CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN left_over USING (doc_id)
""")
def op4_substring_dedup(spark, d):
    """Words of windows of 35 words that also start elsewhere are removed."""
    cut = substring_dedup.remove_repeats(table(spark, d, "documents"), window=35)
    return cut.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


# The verdicts on hosts and paths, as the rules state them.
URL_RULES = [
    ("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"),
]


@query()
def op5_url_filter(spark, d):
    """Verdict on every URL, by rule or by a model fitted on the URLs that rules decide."""
    pages = table(spark, d, "pages")
    model = url_filter.fit_urls(url_filter.labelled_by_rules(pages, URL_RULES))
    return url_filter.judge_urls(pages, URL_RULES, model)


def _sql_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9]+'), lambda w: w <> '')"


_TEMPLATES = ", ".join(f"('{name}', '{notice}')" for name, notice in sorted(license_scan.TEMPLATES.items()))


@query(f"""
WITH t AS (SELECT doc_id, source, lang, contains(coalesce(text, ''), 'icense') AS speaks,
        string_split(coalesce(text, ''), chr(10)) AS ls, {_sql_words("coalesce(text, '')")} AS ws FROM documents),
f AS (SELECT *, dir || '/' || CASE WHEN speaks THEN 'LICENSE' ELSE CAST(doc_id AS VARCHAR) || '.txt' END AS path FROM (
        SELECT *, source || CASE WHEN speaks AND doc_id % 3 = 0 THEN '' WHEN speaks AND doc_id % 3 = 1 THEN '/' || lang
                                 ELSE '/' || lang || '/' || CAST(doc_id // 50 AS VARCHAR) END AS dir FROM t)),
tpl AS (SELECT name, word, count(*) AS n FROM (SELECT name, unnest({_sql_words("notice")}) AS word
        FROM (VALUES {_TEMPLATES}) AS x(name, notice)) GROUP BY ALL),
total AS (SELECT count(*) AS n FROM f),
df AS (SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(ws)) AS word FROM f) GROUP BY word),
idf AS (SELECT word, ln((1 + total.n) / (1 + coalesce(df, 0))) + 1 AS idf
        FROM (SELECT word FROM tpl UNION SELECT word FROM df) LEFT JOIN df USING (word), total),
vec AS (SELECT name, word, n * idf AS w FROM tpl JOIN idf USING (word)),
norm AS (SELECT name, sqrt(sum(w * w)) AS len FROM vec GROUP BY name),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM f),
lw AS (SELECT doc_id, i, word, count(*) AS n FROM (SELECT doc_id, i, unnest({_sql_words("line")}) AS word FROM l) GROUP BY ALL),
ww AS (SELECT doc_id, i, word, lw.n * idf AS w FROM lw JOIN idf USING (word)),
ln AS (SELECT doc_id, i, sqrt(sum(w * w)) AS len FROM ww GROUP BY ALL),
dot AS (SELECT doc_id, i, name, sum(ww.w * vec.w) AS dot FROM ww JOIN vec USING (word) GROUP BY ALL),
near AS (SELECT doc_id, name, round(dot / ln.len / norm.len, 6) AS cosine
         FROM dot JOIN ln USING (doc_id, i) JOIN norm USING (name)),
best AS (SELECT doc_id, name, cosine FROM near WHERE cosine >= 0.7
         QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, name) = 1),
spoken AS (SELECT dir, name FROM f JOIN best USING (doc_id) WHERE speaks
           QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, name) = 1),
above AS (SELECT doc_id, dir AS place, 3 AS depth FROM f UNION SELECT doc_id, source || '/' || lang, 2 FROM f
          WHERE dir <> source UNION SELECT doc_id, source, 1 FROM f),
nearest AS (SELECT above.doc_id, spoken.dir, name FROM above JOIN spoken ON spoken.dir = above.place
            QUALIFY row_number() OVER (PARTITION BY above.doc_id ORDER BY depth DESC) = 1)
SELECT doc_id, path, best.name AS own_license, cosine,
       CASE WHEN best.name IS NULL THEN nearest.dir END AS from_directory,
       coalesce(best.name, nearest.name) AS license
FROM f LEFT JOIN best USING (doc_id) LEFT JOIN nearest USING (doc_id)
""")
def op6_license_scan(spark, d):
    """Licence of every document, its own or that of the nearest directory above.

    Documents lie in a directory of their source, language and number. Those that speak of a licence are
    licence files: by their number of the whole source, of a language in it, or of the directory.
    """
    speaks = F.contains(F.coalesce("text", F.lit("")), F.lit("icense"))
    number = F.floor(F.col("doc_id") / 50).cast("string")
    whole, by_lang = (speaks & (F.col("doc_id") % 3 == i) for i in (0, 1))
    lang = F.when(~F.coalesce(whole, F.lit(False)), F.col("lang"))
    leaf = F.when(~F.coalesce(whole | by_lang, F.lit(False)), number)
    name = F.when(speaks, "LICENSE").otherwise(F.concat("doc_id", F.lit(".txt")))
    docs = table(spark, d, "documents")
    return license_scan.scan_licenses(docs, path=F.concat_ws("/", "source", lang, leaf, name))


@query(r"""
WITH RECURSIVE t AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS s FROM t),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(w[s:s + 4], ' ')) AS h FROM pos),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT * FROM sh WHERE h IN (SELECT h FROM sh GROUP BY h HAVING count(*) > 1)),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i
          FROM met a JOIN met b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * i >= 75 * (x.n + y.n - i)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM t
          UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
SELECT t.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(reach.b) AS component_id
FROM t JOIN reach ON reach.a = t.doc_id LEFT JOIN n USING (doc_id) GROUP BY t.doc_id
""")
def op7_ngram_join(spark, d):
    """Components of documents whose five-word shingles overlap by three quarters or more."""
    return ngram_join.link_documents(table(spark, d, "documents"), width=5, percent=75)


@query("""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(text) AS text_sha256
FROM t WINDOW same AS (PARTITION BY text)
""")
def op8_exact_dedup(spark, d):
    """Every document with the copy that stays, the one with the largest id."""
    return exact_dedup.mark_copies(table(spark, d, "documents"), keep="max")


@query("""
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
          AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings
          UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT a AS vec_id, coalesce(max(n.n), 0) AS n_links, min(b) AS component_id, a = min(b) AS kept
FROM reach LEFT JOIN n ON n.vec_id = a GROUP BY a
""")
def op9_embedding_dedup(spark, d):
    """Embeddings of one label with a cosine of at least 0.98, found through a multi-index."""
    return vector_dedup.link_vectors(table(spark, d, "embeddings"), threshold=0.98)


@query()
def op10_sentencepiece_sampling(spark, d):
    """Two segmentations of every document, drawn without replacement, and the digest of their decoded text."""
    found = sp_sampling.sample(table(spark, d, "documents"), k=2, seed=10, decoded=True)
    return found.withColumn("decoded_sha256", F.sha2(F.col("decoded").cast("binary"), 256)).drop("decoded")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The table of CRC-32 in SQL, and the checksum of the UTF-8 bytes of a string with it.
_CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS tab)"""


def _sql_crc32(text: str) -> str:
    codes = f"list_transform(range(1, 2 * octet_length(encode({text})), 2), lambda k: CAST('0x' || substr(hex({text}), k, 2) AS BIGINT))"
    return (
        f"xor(list_reduce(list_prepend(4294967295, {codes}), "
        "lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"
    )


def _garbled_words(docs: DataFrame) -> DataFrame:
    """Runs of letters of all texts in lower case; one in 31 pairs of document and run has lost a letter."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z\u00C0-\u00FF]{7,}"), 0)).alias("run"))
    low = runs.select("doc_id", F.translate("run", _UPPER, _LOWER).alias("run"))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    at = F.pmod(h, F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return low.select(F.when(h % 31 == 0, cut).otherwise(F.col("run")).alias("word"))


@query(rf"""
WITH RECURSIVE {_CRC_TABLE},
run AS (SELECT doc_id, translate(r, '{_UPPER}', '{_LOWER}') AS r, count(*) AS k
        FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS r FROM documents)
        WHERE length(r) >= 7 GROUP BY ALL),
hashed AS (SELECT r, k, {_sql_crc32("(doc_id || ':' || r)")} AS h FROM run, crc),
w AS (SELECT CASE WHEN h % 31 = 0 THEN r[:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS word, k FROM hashed),
word AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS (SELECT word, i, word[:i - 1] || word[i + 1:] AS v FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM word)),
half AS (SELECT DISTINCT cut.word AS a, word.word AS b FROM cut JOIN word ON cut.v = word.word
         UNION SELECT a.word, b.word FROM cut a JOIN cut b ON a.v = b.v AND a.i = b.i AND a.word < b.word),
near AS (SELECT a AS word, b AS other FROM half UNION SELECT b, a FROM half),
best AS (SELECT near.word, other, o.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near
         FROM near JOIN word o ON o.word = other QUALIFY row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, other) = 1),
found AS (SELECT word.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form,
                 CASE WHEN other_n >= 10 * n THEN other_n END AS form_n FROM word LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS last_word, form AS onward FROM found
         UNION ALL SELECT walk.word, found.word, found.form FROM walk JOIN found ON found.word = walk.onward)
SELECT found.*, last_word AS root FROM found JOIN walk USING (word) WHERE onward IS NULL
""")
def op11_spelling_variants(spark, d):
    """Words of seven letters or more with the ten times more frequent word that they are one edit away from."""
    words = spelling_variants.count_words(_garbled_words(table(spark, d, "documents")), min_length=7, min_count=2)
    return spelling_variants.group_variants(words, min_ratio=10)


def _looped(docs: DataFrame) -> DataFrame:
    """Documents of which one in ten goes round in a circle from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    n = F.size("words")
    looped = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g")).withColumn(
        "words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0))
    )
    looped = looped.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    looped = looped.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    circle = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((n - F.col("a")) / F.col("p")).cast("int")))
    changed = F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), circle), F.lit(1), n)
    return looped.select("doc_id", F.when(F.col("p").isNotNull(), F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))


@query(rf"""
WITH {_CRC_TABLE},
t AS (SELECT doc_id, {WORDS} AS w, {_sql_crc32("CAST(doc_id AS VARCHAR)")} AS h FROM documents, crc),
g AS (SELECT doc_id, w, len(w) AS n, h, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS d FROM t),
v AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
             THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // d) END]) ELSE w END AS w FROM g),
pos AS (SELECT doc_id, n, unnest(w) AS x, unnest(range(n)) AS i FROM v),
pairs AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM pos x JOIN pos y ON x.doc_id = y.doc_id AND x.x = y.x AND x.i < y.i AND 4 * (y.i - x.i) <= x.n),
part AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pairs),
every_run AS (SELECT doc_id, min(i) AS s, count(*) + q AS len, q FROM part GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT doc_id, s, len, min(q) AS q FROM every_run GROUP BY ALL),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM pos ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
sums AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM run GROUP BY doc_id),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len / q DESC, s, q) = 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, len AS length, q AS period, 1000 * len // q AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM v LEFT JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id) LEFT JOIN best USING (doc_id)
""")
def op12_periodic_runs(spark, d):
    """Stretches of words that repeat four times or more, and the digest of the texts without the repetitions."""
    found = periodic_runs.periodic_runs(_looped(table(spark, d, "documents")), min_length=6, min_times=4)
    # Quotients of two numbers below 2 ** 26 differ as doubles whenever they differ.
    best = F.array_max(F.transform(
        "runs", lambda r: F.struct((r["length"] / r["period"]).alias("e"), (-r["start"]).alias("s"), (-r["period"]).alias("p"), r["length"].alias("n"))
    ))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.n").alias("length"),
        (-F.col("best.p")).alias("period"), F.floor(1000 * F.col("best.n") / -F.col("best.p")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"),
    )


# The SQL reads the one kind of markup that these pages have for their articles.
@query(r"""
WITH t AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS a FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(
        regexp_split_to_array(regexp_replace(replace(a, '<br>', ' '), '</?b>', '', 'g'), '</?(p|h1)>'),
        lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'),
                                                     '&amp;?', '&', 'g'), '\s+', ' ', 'g'), ' ')), lambda x: x <> '') AS bs FROM t)
SELECT page_id, url, array_to_string(bs, ' ') AS text, length(array_to_string(bs, ' ')) AS n_chars FROM b
""")
def op13_html_extraction(spark, d):
    """Main text of every page by the template of its host."""
    found = html_extract.extract_text(table(spark, d, "pages"))
    return found.select("page_id", "url", F.col("extracted").alias("text"), F.length("extracted").cast("long").alias("n_chars"))
