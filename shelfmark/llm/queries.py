"""The operators of this subpackage applied to the given tables, and the SQL they must equal where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmark.functions.session import prepare
from shelfmark.llm import decontam, fingerprints, kneser, mixing, neardup, scoring, sharding, simhash, spelling, structure, substrings, tokens, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        # Intermediate results are written tables, so the shuffles of a finished step need not stay on disk.
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
        return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


@query
def op8_token_counts(table) -> DataFrame:
    """Tokens of every document under the byte-level BPE vocabulary."""
    return tokens.token_counts(table("documents"), "byte_bpe_50k.json")


@query
def op9_superminhash_near_duplicates(table) -> DataFrame:
    """Groups of documents whose two-word shingle sets are at least 80 % alike."""
    return neardup.near_duplicates(table("documents"), k=2, share=80)


@query
def op2_golden_ratio_mix(table) -> DataFrame:
    """Words that a mix of 150 % of all words takes from every document."""
    return mixing.mix(table("documents"))


@query
def op6_sampled_splitters(table) -> DataFrame:
    """Eight shards of near-equal bytes."""
    return sharding.shards(table("documents"), 8)


ORACLES["op2_golden_ratio_mix"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source),
rounds AS (
  SELECT 0 AS round, (SELECT 1.5 * sum(source_size) / sum(weight) FROM s) AS level
  UNION ALL
  SELECT r.round + 1, (SELECT (1.5 * (SELECT sum(source_size) FROM s) - sum(CASE WHEN 2 * source_size < weight * r.level THEN 2 * source_size ELSE 0 END))
                       / sum(CASE WHEN 2 * source_size < weight * r.level THEN 0 ELSE weight END) FROM s)
  FROM rounds r WHERE r.round < 60),
goal AS (
  SELECT source, source_size, least(2.0 * source_size, weight * (SELECT max(level) FROM rounds)) AS target FROM s),
laid AS (
  SELECT d.doc_id, d.size, g.source_size, g.target::DOUBLE AS target, round(g.target)::BIGINT AS take,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::VARCHAR) NULLS FIRST, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
  FROM d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE (take // source_size) * size + greatest(0, least(upto, take % source_size) - (upto - size)) END AS taken
FROM laid
"""

ORACLES["op6_sampled_splitters"] = r"""
WITH crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
bytes AS (
  SELECT doc_id, coalesce(text, '') AS body FROM documents),
d AS (
  SELECT doc_id, strlen(body) + 1 AS size, md5(body) AS key,
         list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda h: ('0x' || h)::BIGINT)),
                     lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])) AS c
  FROM bytes, crc_table),
total AS (SELECT sum(size)::BIGINT AS n FROM d),
placed AS (
  SELECT *, (sum(size) OVER (ORDER BY key, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING))::BIGINT - size AS start,
         row_number() OVER (ORDER BY key, doc_id NULLS FIRST) AS place, sum(size) OVER (PARTITION BY key) AS bytes
  FROM d),
grouped AS (
  SELECT *, CASE WHEN bytes > n * 0.01 / 8 THEN start ELSE min(start) OVER (PARTITION BY key) END AS group_start FROM placed, total),
sharded AS (SELECT *, least(7, group_start * 8 // n)::INT AS shard FROM grouped)
SELECT doc_id, size, xor(c, 4294967295)::BIGINT AS text_crc32, 'bytes' AS law, shard,
       (place - min(place) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard
FROM sharded
"""


@query
def op3_weighted_sampling_fingerprints(table) -> DataFrame:
    """Fingerprint of every document and of its edited text, and how alike they are."""
    return fingerprints.fingerprints(table("documents"))


@query
def op1_compression_toxicity(table) -> DataFrame:
    """Probability that each document is toxic, learnt from the labelled documents."""
    return toxicity.toxicity(table("documents"), table("labels"))


@query
def op5_suffix_automata_repeats(table) -> DataFrame:
    """What is left of every document without the passages that an earlier document has."""
    return substrings.remove_repeats(table("documents"), 13)


@query
def op10_cgk_decontamination(table) -> DataFrame:
    """Passages of documents that are benchmark items, up to a fifth of their words."""
    return decontam.leaks(table("documents"), table("benchmark"))


@query
def op4_kneser_ney_quality(table) -> DataFrame:
    """Perplexity of every document under a model of trusted text, and whether it passes the quantiles of its language."""
    return kneser.quality(table("documents"), table("labels"))


@query
def op7_backoff_automaton_scores(table) -> DataFrame:
    """log10 probability of every document under a model of all word pairs of nine tenths of them."""
    return scoring.log_probabilities(table("documents"), cutoff=1)


ORACLES["op5_suffix_automata_repeats"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, unnest(k) AS key, generate_subscripts(k, 1) AS i
  FROM (SELECT doc_id, list_transform(range(1, greatest(1, len(w) - 11)), lambda i: md5(array_to_string(w[i:i + 12], ' '))) AS k FROM d)),
firsts AS (SELECT key, min(doc_id) AS first FROM windows GROUP BY key),
gone AS (
  SELECT DISTINCT doc_id, i + o AS pos FROM windows JOIN firsts USING (key), (SELECT unnest(range(13)) AS o) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS body FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

ORACLES["op9_superminhash_near_duplicates"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, greatest(1, len(w))), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
sizes AS (SELECT doc_id, len(g) AS n FROM sets),
shingles AS (SELECT doc_id, unnest(g) AS g FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS id, a AS other FROM sides UNION SELECT r.id, e.b FROM reach r JOIN sides e ON r.other = e.a),
groups AS (SELECT id, min(other) AS low FROM reach GROUP BY id)
SELECT doc_id, n AS n_shingles, coalesce(low, doc_id) AS component_id, coalesce(low, doc_id) = doc_id AS kept
FROM sizes LEFT JOIN groups ON id = doc_id
"""


@query
def op11_run_length_structure_repair(table) -> DataFrame:
    """Faults and cheapest repair of every conversation, after planted damage."""
    conversations = table("conversations")
    return structure.repair_report(conversations, structure.damaged(conversations))


@query
def op12_bit_sliced_simhash(table) -> DataFrame:
    """Groups of documents whose fingerprints differ in at most four bits."""
    return simhash.near_duplicates(table("documents"), k=4, radius=4)


@query
def op13_sorted_list_spelling_variants(table) -> DataFrame:
    """Words of all documents, the commoner word one edit away from each, and where that leads."""
    return spelling.variants(spelling.word_counts(table("documents"), every=199))


_CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i))"""


def _crc(text: str) -> str:
    return (
        f"xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)), "
        "lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295)"
    )


def _way(state: str, cost: str, letter: str, row: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {state}.r || {row}}}"


def _least(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


_USER, _ASSISTANT, _KEPT, _NONE = "chr(10) || 'user:'", "chr(10) || 'assistant:'", "chr(10) || role || ':' || text", "''"
_FAR = "1000000000"
_REROLE = f"CASE WHEN keepable THEN 2 + cut ELSE {_FAR} END"


def _kept_as(initial: str) -> str:
    return f"CASE WHEN keepable AND x = '{initial}' THEN cut ELSE {_FAR} END"


ORACLES["op11_run_length_structure_repair"] = rf"""
WITH RECURSIVE {_CRC_TABLE},
raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS d
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM raw WHERE d <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
marked AS (
  SELECT *, left(role, 1) AS x, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS x_before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (i > 1 AND x_before || x NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM marked GROUP BY conv_id),
walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS s0, {{'c': {_FAR}::BIGINT, 'a': '', 'r': ''}} AS s1,
         {{'c': {_FAR}::BIGINT, 'a': '', 'r': ''}} AS s2, {{'c': {_FAR}::BIGINT, 'a': '', 'r': ''}} AS s3
  FROM marked
  UNION ALL
  SELECT conv_id, i + 1,
         {_way('w0', '3', 'D', _NONE)} AS s0,
         {_least(_way('w1', '3', 'D', _NONE), _way('w0', _kept_as('s'), 'K', _KEPT))} AS s1,
         {_least(_way('w2', '3', 'D', _NONE), *[_way(w, _kept_as('u'), 'K', _KEPT) for w in ('w0', 'w1', 'w3')],
                 *[_way(w, _REROLE, 'R', f'{_USER} || text') for w in ('w0', 'w1', 'w3')])} AS s2,
         {_least(_way('w3', '3', 'D', _NONE), _way('w2', _kept_as('a'), 'K', _KEPT), _way('w2', _REROLE, 'R', f'{_ASSISTANT} || text'))} AS s3
  FROM (
    SELECT w.conv_id, w.i, m.x, m.role, m.text, m.fault NOT IN ('blank', 'duplicate') AS keepable, CASE WHEN m.fault = 'truncated' THEN 1 ELSE 0 END AS cut,
           s0 AS w0, s1 AS w1,
           {_least('s2', _way('s0', '2', 'I', _USER), _way('s1', '2', 'I', _USER), _way('s3', '2', 'I', _USER))} AS w2,
           {_least('s3', _way('s2', '2', 'I', _ASSISTANT), _way('s0', '4', 'II', f'{_USER} || {_ASSISTANT}'), _way('s1', '4', 'II', f'{_USER} || {_ASSISTANT}'))} AS w3
    FROM walk w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1)),
ended AS (
  SELECT w.conv_id, {_least('s0', 's3', _way('s2', '2', 'I', _ASSISTANT), _way('s1', '4', 'II', f'{_USER} || {_ASSISTANT}'))} AS best
  FROM walk w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.i)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(substr(coalesce(best.r, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""

ORACLES["op13_sorted_list_spelling_variants"] = rf"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run
  FROM documents),
hashed AS (
  SELECT run, times, {_crc("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h
  FROM (SELECT doc_id, run, count(*) AS times FROM runs WHERE length(run) >= 6 GROUP BY ALL), crc_table),
v AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(times)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(times) >= 5),
cuts AS (
  SELECT word, n, i, left(word, i::INT) || substr(word, i::INT + 2) AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
near AS (
  SELECT a.word AS word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN v b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN v b ON a.less = b.word),
best AS (
  SELECT word, count(*) AS n_near, list_sort(list({{'x': -m, 'other': other}}))[1] AS best FROM near GROUP BY word),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.x >= 5 * n THEN best.other END AS form, CASE WHEN -best.x >= 5 * n THEN -best.x END AS form_n
  FROM v LEFT JOIN best USING (word)),
ways AS (
  SELECT word, word AS root, 0 AS far FROM formed
  UNION ALL SELECT w.word, f.form, far + 1 FROM ways w JOIN formed f ON f.word = w.root WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, max_by(root, far) AS root FROM ways GROUP BY word) USING (word)
"""
