"""Queries over messages, token counts, files, lines and metric exports."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowguard import constants as K
from windowguard.functions import scalars as S
from windowguard.operators import logs, profile, series, textmodels
from windowguard.plans import service_queries
from windowguard.plans import sql as Q
from windowguard.plans.registry import query, rounded
from windowguard.session import stage
from windowguard.sources import tables as A


@query(
    """WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
    lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no FROM cut),
    normal AS (SELECT *, regexp_replace(lower(line), '[0-9]+', '0', 'g') AS m FROM lines)
    SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(length(line) AS INT) AS e_message_len, md5(m) AS normalized_md5,
      CAST(len(string_split(m, ' ')) AS INT) AS n_words, CAST(greatest(length(m) - 2, 0) AS INT) AS n_trigrams,
      list_min(list_transform(range(1, length(m) - 1), lambda i: substring(m, i, 3))) AS first_trigram
    FROM normal"""
)
def message_features(spark, folder):
    """Length, normalised text, words and trigrams of every document line."""
    features = textmodels.message_features(A.document_lines(spark, folder), "line")
    return features.select(
        "doc_id",
        "line_no",
        "e_message_len",
        F.md5("e_message_normalized").alias("normalized_md5"),
        F.size("e_words").alias("n_words"),
        F.size("e_trigrams").alias("n_trigrams"),
        F.array_min("e_trigrams").alias("first_trigram"),
    )


@query(
    """WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
    lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no FROM cut)
    SELECT doc_id, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS total FROM lines
    WHERE line_no % 3 <> 1 GROUP BY 1"""
)
def message_nulls(spark, folder):
    """Messages of documents in which every third one is missing: those are left out."""
    missing = F.when(F.col("line_no") % 3 != 1, F.col("line"))
    lines = A.document_lines(spark, folder).withColumn("message", missing)
    features = textmodels.message_features(lines, "message", trigrams="word")
    return features.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("e_message_len").alias("total"))


#: Stands for a system turn among the words; no word holds a space.
SYSTEM_TURN = "system turn"
TOKENS = """turns AS (SELECT conv_id, role, string_split(regexp_replace(lower(text), '[0-9]+', '0', 'g'), ' ') AS words
  FROM conversations),
tokens AS (SELECT conv_id, token, count(*) AS n FROM (SELECT conv_id, unnest(words) AS token FROM turns) GROUP BY ALL),
abnormal AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system'),
train AS (SELECT * FROM tokens WHERE substring(md5('42:' || conv_id), 1, 8) >= '80000000'
  AND conv_id NOT IN (SELECT conv_id FROM abnormal)),
test AS (SELECT * FROM tokens WHERE substring(md5('42:' || conv_id), 1, 8) < '80000000'),
vocabulary AS (SELECT token, count(*) AS df FROM train GROUP BY 1)"""


def _tokens(spark, folder) -> DataFrame:
    return textmodels.sequence_tokens(A.conversation_tokens(spark, folder), "conv_id", "words")


def _labelled_tokens(spark, folder) -> DataFrame:
    """Token counts of all conversations, stored, with ``label`` 1 where there is a system turn.

    Text and roles are read in one scan; both halves of a split then filter the stored counts.
    """
    turns = A.conversation_tokens(spark, folder)
    roles = turns.withColumn("words", F.array_append(F.coalesce("words", F.array().cast("array<string>")), F.when(F.col("role") == "system", SYSTEM_TURN)))
    counts = stage(textmodels.sequence_tokens(roles, "conv_id", "words"), "tokens")
    marked = counts.where(F.col("token") == SYSTEM_TURN).select("conv_id", F.lit(1.0).alias("label")).distinct()
    words = counts.where(F.col("token").isNotNull() & (F.col("token") != SYSTEM_TURN))
    return words.join(stage(marked, "system-turns"), "conv_id", "left").fillna(0.0, subset=["label"])


def _split(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Token counts of normal training conversations and of all test conversations."""
    train, test = textmodels.split_by_hash(_labelled_tokens(spark, folder), "conv_id")
    return train.where("label = 0").drop("label"), test.drop("label")


@query(f"WITH {TOKENS} SELECT conv_id, token, n FROM tokens")
def sequence_tokens(spark, folder):
    """Words of every conversation with their count."""
    return _tokens(spark, folder)


@query("SELECT conv_id, count(*) AS seq_len FROM conversations GROUP BY 1")
def sequence_lengths(spark, folder):
    """Turns of every conversation."""
    return textmodels.sequence_lengths(A.conversation_tokens(spark, folder), "conv_id")


@query(
    f"""WITH {TOKENS} SELECT conv_id, CAST(sum(n) AS BIGINT) AS n_tokens,
    CAST(coalesce(sum(n) FILTER (df IS NULL), 0) AS BIGINT) AS oov_count
    FROM test LEFT JOIN vocabulary USING (token) GROUP BY 1"""
)
def oov_score(spark, folder):
    """Words of test conversations that no normal training conversation has."""
    return textmodels.oov_score(*_split(spark, folder), "conv_id")


@query(
    f"""WITH {TOKENS}, total AS (SELECT count(DISTINCT conv_id) AS total FROM train)
    SELECT conv_id, round(coalesce(sum(n * -ln(df / total)), 0), 6) + 0 AS rarity
    FROM test LEFT JOIN vocabulary USING (token), total GROUP BY 1"""
)
def rarity_score(spark, folder):
    """Rarity of the words of test conversations among normal training conversations."""
    return rounded(textmodels.rarity_score(*_split(spark, folder), "conv_id"))


SWEEP = """turns AS (SELECT doc_id, source, lang, unnest(string_split(lower(text), ' ')) AS token FROM documents),
tokens AS (SELECT source, doc_id, lang, token, count(*) AS n FROM turns GROUP BY ALL),
vocabulary AS (SELECT source, token FROM tokens WHERE lang = 'en' GROUP BY ALL)"""


@query(
    f"""WITH {SWEEP} SELECT t.source, t.doc_id, CAST(sum(n) AS BIGINT) AS n_tokens,
    CAST(coalesce(sum(n) FILTER (v.token IS NULL), 0) AS BIGINT) AS oov_count
    FROM tokens t LEFT JOIN vocabulary v ON t.source = v.source AND t.token = v.token GROUP BY 1, 2"""
)
def oov_sweep(spark, folder):
    """Words of every document unseen in the English documents of its source, all sources at once."""
    docs = A.table(spark, folder, "documents").withColumn("words", F.split(F.lower("text"), " "))
    tokens = stage(textmodels.sequence_tokens(docs, "doc_id", "words", ["source", "lang"]), "tokens")
    normal = tokens.where(F.col("lang") == "en")
    return textmodels.oov_score(normal, tokens, "doc_id", ["source"])


@query(
    f"""WITH {TOKENS}, total AS (SELECT count(DISTINCT conv_id) AS total FROM train),
    raw AS (SELECT conv_id, token, n * (ln((total + 1) / (df + 1)) + 1) AS w FROM test JOIN vocabulary USING (token), total)
    SELECT conv_id, token, round(w / sqrt(sum(w * w) OVER (PARTITION BY conv_id)), 9) AS weight FROM raw"""
)
def text_vectors(spark, folder):
    """Every cell of the TF-IDF vectors of the test conversations."""
    train, test = _split(spark, folder)
    cells = textmodels.vector_cells(train, test, "conv_id")
    return rounded(cells.select("conv_id", "token", "weight"), 9)


@query(
    f"""WITH {TOKENS}, total AS (SELECT count(DISTINCT conv_id) AS total FROM train)
    SELECT conv_id, CAST(count(df) AS INT) AS cells, (SELECT CAST(count(*) AS INT) FROM vocabulary) AS size,
    CASE WHEN count(df) > 0 THEN 1e0 ELSE 0e0 END AS norm
    FROM test LEFT JOIN vocabulary USING (token), total GROUP BY 1"""
)
def vector_shapes(spark, folder):
    """Number of cells, size and length of the vectors that models are fitted on."""
    _, test = textmodels.vectorize(*_split(spark, folder), "conv_id")
    vector = F.unwrap_udt("features")
    square = F.aggregate(vector["values"], F.lit(0.0), lambda acc, x: acc + x * x)
    return test.select(
        "conv_id",
        F.size(vector["indices"]).alias("cells"),
        vector["size"].alias("size"),
        F.round(F.sqrt(square), 6).alias("norm"),
    )


def _classified(spark, folder, model: str) -> DataFrame:
    tokens = _labelled_tokens(spark, folder)
    label = stage(tokens.select("conv_id", "label").distinct(), "labels")
    train, test = textmodels.split_by_hash(tokens.drop("label"), "conv_id")
    train, test = textmodels.vectorize(train, test, "conv_id")
    scored = textmodels.fit_predict(train.join(label, "conv_id"), test.join(label, "conv_id"), model)
    return scored.select("conv_id", "label", "score")


@query()
def decision_tree(spark, folder):
    """Probability that a test conversation has a system turn, by a decision tree."""
    return _classified(spark, folder, "tree")


@query()
def logistic_regression(spark, folder):
    """Probability that a test conversation has a system turn, by logistic regression."""
    return _classified(spark, folder, "logistic")


HALVES = """turns AS (SELECT conv_id, CAST(count(*) AS DOUBLE) AS x, max(CASE WHEN role = 'system' THEN 1e0 ELSE 0e0 END) AS system_turn
  FROM conversations GROUP BY 1),
marked AS (SELECT *, substring(md5('42:' || conv_id), 1, 8) >= '80000000' AS in_train FROM turns)"""


def _by_turns(spark, folder, label, feature):
    """Halves of the conversations with one feature made of their number of turns."""
    turns = A.table(spark, folder, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.max((F.col("role") == "system").cast("double")).alias("system_turn")
    )
    rows = stage(turns.select("conv_id", label.alias("label"), feature.cast("double").alias("x")), "turns")
    vectors = rows.withColumn("features", array_to_vector(F.array("x")))
    return textmodels.split_by_hash(vectors, "conv_id")


@query(f"""WITH {HALVES} SELECT conv_id, CASE WHEN x > 4 THEN 1e0 ELSE 0e0 END AS score FROM marked WHERE NOT in_train""")
def tree_threshold(spark, folder):
    """A tree on conversations whose class is a threshold on one feature learns the threshold."""
    turns = F.col("turns")
    train, test = _by_turns(spark, folder, (turns > 4).cast("double"), turns)
    return textmodels.fit_predict(train, test, "tree").select("conv_id", "score")


@query(
    f"""WITH {HALVES}, rates AS (SELECT x > 4 AS long, avg(system_turn) AS rate FROM marked WHERE in_train GROUP BY 1)
    SELECT conv_id, round(rate, 4) AS score FROM marked JOIN rates ON (x > 4) = long WHERE NOT in_train"""
)
def logistic_groups(spark, folder):
    """Logistic regression on one binary feature gives the training rate of each group."""
    train, test = _by_turns(spark, folder, F.col("system_turn"), F.col("turns") > 4)
    return rounded(textmodels.fit_predict(train, test, "logistic").select("conv_id", "score"), 4)


@query(
    f"""WITH {Q.EV}, {Q.LOG_CHAIN}, counts AS (SELECT case_id || '/' || service_name AS seq, template_id, count(*) AS n FROM matched GROUP BY 1, 2)
    SELECT seq, template_id AS token, n FROM counts"""
)
def event_sequences(spark, folder):
    """Template ids as the events of a sequence, one per case and service."""
    lines, templates = service_queries.condensed_logs(spark, folder)
    matched = logs.match_templates(lines, templates)
    named = matched.withColumn("seq", F.concat_ws("/", "case_id", "service_name"))
    return named.groupBy("seq", F.col("template_id").alias("token")).agg(F.sum("n").alias("n"))


INDEX = """idx AS (SELECT 'run' || l_suppkey AS run,
  CASE l_linenumber WHEN 1 THEN 'correct' ELSE 'error_' || l_linenumber END AS test_name,
  l_returnflag AS service FROM lineitem)"""


def _index(spark, folder) -> DataFrame:
    error = F.concat(F.lit("error_"), F.col("l_linenumber").cast("string"))
    return A.table(spark, folder, "lineitem").select(
        F.concat(F.lit("run"), F.col("l_suppkey").cast("string")).alias("run"),
        F.when(F.col("l_linenumber") == 1, "correct").otherwise(error).alias("test_name"),
        F.col("l_returnflag").alias("service"),
    )


CHOSEN_RUNS = """runs AS (SELECT run, md5('42|' || run) AS dice FROM (SELECT DISTINCT run FROM idx)
  ORDER BY dice, run LIMIT {n}),
tests AS (SELECT DISTINCT run, test_name FROM idx JOIN runs USING (run))"""
COUNT_CHOSEN = """SELECT run, test_name, service, count(*) AS n FROM idx JOIN (
  SELECT run, test_name FROM tests WHERE test_name = 'correct' UNION ALL SELECT run, test_name FROM picked)
  USING (run, test_name) GROUP BY ALL"""


@query(
    f"""WITH {INDEX}, {CHOSEN_RUNS.format(n=10)}, picked AS (SELECT run, test_name FROM (
      SELECT *, row_number() OVER (PARTITION BY run ORDER BY md5('42|' || run || '|' || test_name), test_name) AS r
      FROM tests WHERE test_name <> 'correct') WHERE r <= 2) {COUNT_CHOSEN}"""
)
def run_sampling(spark, folder):
    """Files of ten runs with the normal test and two error tests each."""
    chosen = textmodels.sample_runs(_index(spark, folder), 10, 2)
    return chosen.groupBy("run", "test_name", "service").agg(F.count("*").alias("n"))


@query(
    f"""WITH {INDEX}, {CHOSEN_RUNS.format(n=3)},
    seats AS (SELECT run, row_number() OVER (ORDER BY dice, run) - 1 AS seat FROM runs),
    kinds AS (SELECT test_name, row_number() OVER (ORDER BY md5('42|' || test_name)) - 1 AS place
      FROM (SELECT DISTINCT test_name FROM tests WHERE test_name <> 'correct')),
    picked AS (SELECT t.run, t.test_name FROM tests t JOIN seats s ON t.run = s.run
      JOIN kinds k ON t.test_name = k.test_name AND k.place // 2 = s.seat) {COUNT_CHOSEN}"""
)
def run_sampling_distinct(spark, folder):
    """Files of three runs with two error tests each, no error test in two runs."""
    chosen = textmodels.sample_runs(_index(spark, folder), 3, 2, dup_errors=False)
    return chosen.groupBy("run", "test_name", "service").agg(F.count("*").alias("n"))


STACK = r"at\s+[\w\.$/_-]+\.[^(]+\([^)]*\)"
TYPED = rf"""typed AS (SELECT regexp_replace(service_name || '-1.log', '-[^-]*$', '') AS base_filename,
  CASE WHEN regexp_matches(line, 'DEBUG') THEN 'DEBUG' WHEN regexp_matches(line, 'INFO') THEN 'INFO'
    WHEN regexp_matches(line, 'WARN') THEN 'WARN' WHEN regexp_matches(line, 'ERROR') THEN 'ERROR'
    WHEN regexp_matches(line, '{STACK}') THEN 'STACKTRACE'
    WHEN regexp_matches(line, '[\w\.]+Exception:') THEN 'EXCEPTION' ELSE 'OTHER' END AS log_type
  FROM lines WHERE regexp_matches(line, '\S'))"""


def _typed(spark, folder) -> DataFrame:
    lines = A.log_lines(spark, folder).select(
        F.concat("service_name", F.lit("-1.log")).alias("file_name"), "line"
    )
    return profile.log_types(lines)


@query(
    f"""WITH {Q.EV}, {Q.LINES}, {TYPED} SELECT base_filename, log_type, count(*) AS "count" FROM typed
    GROUP BY GROUPING SETS ((log_type), (base_filename), (base_filename, log_type))"""
)
def log_type_counts(spark, folder):
    """Log lines by type, by file and by both."""
    return profile.log_type_counts(_typed(spark, folder))


PLACED = r"""placed AS (SELECT service_name || CASE WHEN k % 2 = 0 THEN '-1.log' ELSE '-1.txt' END AS file_name,
  CASE WHEN k % 5 = 0 THEN 'run/metrics' ELSE 'run/' || case_id END AS subdirectory, event_id FROM ev)"""


@query(
    f"""WITH {Q.EV}, {Q.LINES}, {PLACED} SELECT subdirectory, file_name, count(*) AS n FROM placed JOIN lines USING (event_id)
    WHERE file_name LIKE '%shop%.log' AND subdirectory NOT LIKE '%metrics%' GROUP BY ALL"""
)
def service_log_files(spark, folder):
    """Lines of the log files of one service outside metrics folders."""
    numbers = A.events(spark, folder).select("event_id", "k")
    lines = A.log_lines(spark, folder).join(numbers, "event_id")
    ending = F.when(F.col("k") % 2 == 0, "-1.log").otherwise("-1.txt")
    place = F.when(F.col("k") % 5 == 0, "run/metrics").otherwise(F.concat(F.lit("run/"), "case_id"))
    named = lines.select(place.alias("subdirectory"), F.concat("service_name", ending).alias("file_name"), "line")
    return profile.service_logs(named, "shop").groupBy("subdirectory", "file_name").agg(F.count("*").alias("n"))


# Every service of the events; the query finds the names by itself.
PIVOTED = [f"svc-{name}" for name in ("order", "other", "shop", "user")]


@query(
    f"""WITH {Q.EV}, {Q.LINES}, {TYPED} SELECT log_type,
    {", ".join(f"count(*) FILTER (base_filename = '{f}') AS " + '"' + f[4:] + '"' for f in PIVOTED)}
    FROM typed GROUP BY 1"""
)
def log_type_pivot(spark, folder):
    """Line types by service."""
    return profile.log_type_pivot(_typed(spark, folder), prefix="svc-")


def _range_results(spark, folder) -> DataFrame:
    """One range result per line item: two values of a labelled series, some of another job."""
    start = F.unix_seconds(F.col("l_shipdate").cast("timestamp"))
    job = F.when(F.col("l_tax") > 0.07, "other").otherwise("node")
    labels = F.create_map(
        F.lit("__name__"), F.concat(F.lit("node_m"), F.col("l_linenumber").cast("string")),
        F.lit("job"), job, F.lit("instance"), F.lit("host:9100"), F.lit("group"), F.lit("a"),
    )
    told = F.create_map(F.lit("mode"), F.col("l_linestatus"), F.lit("cpu"), F.col("l_returnflag"))
    values = F.array(
        F.array(start.cast("string"), F.col("l_partkey").cast("string")),
        F.array((start + 86_400).cast("string"), F.col("l_suppkey").cast("string")),
    )
    return A.table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("run_end"),
        F.col("l_linestatus").alias("test_name"),
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        F.when(F.col("l_linenumber") <= 4, F.map_concat(labels, told)).otherwise(labels).alias("metric"),
        values.alias("values"),
    )


@query(
    """SELECT 'node_m' || l_linenumber || CASE WHEN l_linenumber <= 4 THEN '&mode=' || l_linestatus || '&cpu=' || l_returnflag
    ELSE '' END AS metric_name, count(*) * 2 AS n FROM lineitem WHERE NOT l_tax > 0.07e0 GROUP BY 1"""
)
def metric_label_name(spark, folder):
    """Values per series name."""
    long = profile.prom_long(_range_results(spark, folder))
    return long.groupBy("metric_name").agg(F.count("*").alias("n"))


# Every series of the line items; the query finds the names by itself.
WIDE_NAMES = [f"node_m{i}" for i in (5, 6, 7)] + [
    f"node_m{i}&mode={status}&cpu={flag}" for i in (1, 2, 3, 4) for status in "FO" for flag in "ANR"
]


@query(
    f"""WITH long AS (
      SELECT l_returnflag AS run_end, l_linestatus AS test_name, 'node_m' || l_linenumber ||
          CASE WHEN l_linenumber <= 4 THEN '&mode=' || l_linestatus || '&cpu=' || l_returnflag ELSE '' END AS metric_name,
        CAST(epoch_ms(l_shipdate) // 1000 + p * 86400 AS VARCHAR) AS "timestamp",
        CAST(CASE p WHEN 0 THEN l_partkey ELSE l_suppkey END AS VARCHAR) AS value,
        l_orderkey, l_partkey, l_suppkey, p
      FROM lineitem, (VALUES (0), (1)) AS t(p) WHERE NOT l_tax > 0.07e0),
    last AS (SELECT *, row_number() OVER (PARTITION BY run_end, test_name, "timestamp", metric_name
      ORDER BY l_orderkey DESC, l_partkey DESC, l_suppkey DESC, p DESC) AS r FROM long)
    SELECT run_end, test_name, "timestamp", {", ".join(f"max(value) FILTER (metric_name = '{m}') AS " + '"' + m + '"' for m in sorted(WIDE_NAMES))}
    FROM last WHERE r = 1 GROUP BY 1, 2, 3"""
)
def metric_wide_pivot(spark, folder):
    """Every series by run, test and time, the last of several values kept."""
    long = profile.prom_long(_range_results(spark, folder))
    order = ["l_orderkey", "l_partkey", "l_suppkey", "position"]
    return profile.prom_wide(long, ["run_end", "test_name"], order)


LAST_VALUES = """WITH long AS (
      SELECT l_returnflag AS run_end, l_linestatus AS test_name, 'node_m' || l_linenumber ||
          CASE WHEN l_linenumber <= 4 THEN '&mode=' || l_linestatus || '&cpu=' || l_returnflag ELSE '' END AS metric_name,
        CAST(epoch_ms(l_shipdate) // 1000 + p * 86400 AS VARCHAR) AS "timestamp",
        CAST(CASE p WHEN 0 THEN l_partkey ELSE l_suppkey END AS VARCHAR) AS value,
        l_orderkey, l_partkey, l_suppkey, p
      FROM lineitem, (VALUES (0), (1)) AS t(p) WHERE NOT l_tax > 0.07e0),
    last AS (SELECT *, row_number() OVER (PARTITION BY run_end, test_name, "timestamp", metric_name
      ORDER BY l_orderkey DESC, l_partkey DESC, l_suppkey DESC, p DESC) AS r FROM long)"""


@query(
    f"""{LAST_VALUES}, names AS (SELECT DISTINCT metric_name FROM long), times AS (SELECT DISTINCT run_end, test_name, "timestamp" FROM long)
    SELECT run_end, test_name, "timestamp", "timestamp" || ',' || string_agg(coalesce(value, ''), ',' ORDER BY n.metric_name) AS line
    FROM times t CROSS JOIN names n LEFT JOIN (FROM last WHERE r = 1) USING (run_end, test_name, "timestamp", metric_name) GROUP BY 1, 2, 3
    UNION ALL SELECT NULL, NULL, NULL, 'timestamp,' || string_agg(metric_name, ',' ORDER BY metric_name) FROM names"""
)
def metric_wide_lines(spark, folder):
    """The same table as lines of text with their header, without a column per series."""
    long = stage(profile.prom_long(_range_results(spark, folder)), "series")
    names = profile.prom_dictionary(long)
    lines = profile.prom_wide_lines(long, ["run_end", "test_name"], ["l_orderkey", "l_partkey", "l_suppkey", "position"], names)
    return lines.unionByName(profile.prom_header(names), allowMissingColumns=True)


PAGE_FILES = """inv AS (SELECT 'root/run-1/' || CASE WHEN contains(url, '/en/') THEN 'correct' ELSE 'error' END AS folder,
  regexp_extract(url, '^[a-z]+://([^/]+)/', 1) || CASE WHEN contains(url, '?') THEN '.csv' ELSE '.log' END AS name,
  length(html) AS size FROM pages)"""


@query(
    f"""WITH {PAGE_FILES} SELECT name, count(*) AS "count", round(avg(size / 1024e0), 6) AS mean,
    round(quantile_cont(size / 1024e0, 0.5), 6) AS median, round(coalesce(stddev_samp(size / 1024e0), 0), 6) AS std_dev,
    round(min(size / 1024e0), 6) AS min, round(max(size / 1024e0), 6) AS max
    FROM inv WHERE NOT contains(folder, 'correct') GROUP BY 1"""
)
def file_size_stats(spark, folder):
    """Size statistics of the files of error runs, by name."""
    return rounded(profile.file_size_stats(A.page_inventory(spark, folder), "error", "run-"))


LINE_FILES = """cut AS (SELECT source, doc_id, lang, string_split(text, chr(10)) AS l FROM documents),
lines AS (SELECT source, doc_id, lang, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no FROM cut),
inv AS (SELECT source || '/' || doc_id AS folder, source, 'part' || line_no || CASE lang WHEN 'en' THEN '.csv' ELSE '.log' END AS name,
  length(line) AS size FROM lines),
marked AS (SELECT *, size = 0 OR (name LIKE '%.csv' AND size = 58) AS is_empty FROM inv),
items AS (
  SELECT 'file' AS kind, name, name IN ('part0.csv', 'part1.log') AS expected FROM marked WHERE is_empty
  UNION ALL SELECT 'dir', regexp_extract(folder, '[^/]*$'), false FROM marked GROUP BY folder HAVING bool_and(is_empty)
  UNION ALL SELECT 'dir', source, false FROM marked GROUP BY source HAVING bool_and(is_empty))"""
EXPECTED = ["part0.csv", "part1.log"]


@query(
    f"""WITH {LINE_FILES} SELECT name, count(*) AS "count",
    array_to_string(list_sort(list_distinct(list(kind))), '/') AS type FROM items GROUP BY 1"""
)
def empty_file_profile(spark, folder):
    """Names of empty files and folders with their frequency."""
    return profile.empty_profile(A.line_inventory(spark, folder), EXPECTED)


@query(
    f"""WITH {LINE_FILES} SELECT count(*) FILTER (kind = 'dir') AS empty_dirs,
    count(*) FILTER (kind = 'file' AND name LIKE '%.csv') AS empty_csv_files,
    count(*) FILTER (kind = 'file' AND name NOT LIKE '%.csv') AS other_empty_files,
    count(*) FILTER (name IN ('part0.csv', 'part1.log')) AS expected_empty,
    count(*) FILTER (NOT expected) AS unexpected_empty FROM items"""
)
def empty_breakdown(spark, folder):
    """Totals over empty files and folders."""
    return profile.empty_breakdown(A.line_inventory(spark, folder), EXPECTED)


@query(
    """WITH cut AS (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents),
    lines AS (SELECT doc_id, lang, len(l) AS n, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no FROM cut)
    SELECT doc_id, CAST(line_no AS INT) AS line_no, line FROM lines
    WHERE line_no >= 2 AND line_no - 2 < CASE lang WHEN 'en' THEN floor((n - 2) / 2.05e0) ELSE n - 2 END"""
)
def head_trim_fraction(spark, folder):
    """Document lines without the first two, of English documents only part of the rest."""
    run = F.when(F.col("lang") == "en", "correct").otherwise("error")
    path = F.concat_ws("/", run, F.col("doc_id").cast("string"), F.lit("part.log"))
    lines = A.document_lines(spark, folder).withColumn("path", path)
    trimmed = profile.trim_lines(lines, 2, 2.05, ["part.log"])
    return trimmed.select("doc_id", "line_no", "line")


MERGED = """merged AS (
  SELECT CAST(epoch_ms(o_orderdate) // 1000 AS VARCHAR) AS "timestamp", 'order' AS run_end,
    CAST(o_orderkey AS VARCHAR) AS value FROM orders
  UNION ALL SELECT CAST(epoch_ms(l_shipdate) // 1000 AS VARCHAR), 'line', CAST(l_orderkey AS VARCHAR) FROM lineitem)"""


def _text_tables(spark, folder) -> list[DataFrame]:
    def texts(table: str, time: str, kind: str, value: str) -> DataFrame:
        return A.table(spark, folder, table).select(
            F.unix_seconds(F.col(time).cast("timestamp")).cast("string").alias("timestamp"),
            F.lit(kind).alias("run_end"),
            F.col(value).cast("string").alias("value"),
        )

    orders = texts("orders", "o_orderdate", "order", "o_orderkey")
    return [orders, texts("lineitem", "l_shipdate", "line", "l_orderkey")]


@query(f"WITH {MERGED} SELECT * FROM merged")
def merge_sorted(spark, folder):
    """Two text tables as one in time order."""
    return profile.merge_sorted(_text_tables(spark, folder), "timestamp")


@query(f"""WITH {MERGED} SELECT *, row_number() OVER (ORDER BY "timestamp", run_end, value) - 1 AS position FROM merged""")
def merge_positions(spark, folder):
    """The place of every row of two text tables in their common order, which is that of texts."""
    orders, lines = _text_tables(spark, folder)
    return series.numbered(orders.unionByName(lines), ["timestamp", "run_end", "value"])


@query(
    f"""WITH {Q.EV}, last AS (SELECT max((ts_ms, event_id)) AS m FROM
      (SELECT ts_ms, event_id FROM ev ORDER BY ts_ms, event_id LIMIT 13))
    SELECT event_id, CASE WHEN (ts_ms, event_id) <= m THEN 'head' ELSE 'tail' END AS part FROM ev, last"""
)
def positional_split(spark, folder):
    """Events marked as the first thirteen or the rest."""
    events = A.events(spark, folder).select("event_id", "ts_ms")
    return profile.positional_split(events, ["ts_ms", "event_id"], 13).select("event_id", "part")
