"""The registered queries of the subpackage: each applies its operator to its whole table."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelprism.llm import bpe, chat, decontaminate, lattice, quality, repair, runs, secret_scan, simhash, substring, token_counts, token_files, toxicity
from labelprism.llm.common import WHITE, public_path, read, shared_folder

__all__ = ["QUERIES", "ORACLE"]

WORD_BPE, PIECE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model"


def sha(column) -> F.Column:
    return F.sha2(column.cast("binary"), 256)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that an earlier window of 20 words has, removed."""
    found = substring.substring_dedup(read(spark, sf_dir, "documents"), window=20)
    return found.select("doc_id", "n_words", "n_removed", sha(F.col("text")).alias("kept_sha256"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside 10-word windows of benchmark items, and the items."""
    found = decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", sha(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


TRICKY = r"\### Assistant: </turn> ok"


def _read_back(batches):
    """Digests of conversations from their formatted text and loss spans alone."""
    for b in batches:
        out = [[] for _ in range(6)]
        for formatted, loss in zip(b.column("formatted").to_pylist(), b.column("loss").to_pylist()):
            turns = chat.parse_turns(formatted)
            learnt = "".join(chat.unescape(formatted[s["start"]: s["end"]]) for s in loss)
            whole = "".join(f"{role}\n{text}\n" for role, text in turns)
            for column, value in zip(out, (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(formatted))):
                column.append(value)
        yield pa.record_batch([b.column("tree"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()),
                               pa.array(out[3], pa.string()), pa.array(out[4], pa.int64())],
                              ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that holds control strings, formatted, and read back."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], rows.schema)
    formatted = chat.format_paths(chat.reply_paths(chat.chains(rows.unionByName(own)), branches=1))
    return formatted.select("tree", "formatted", "loss").mapInArrow(
        _read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 3-word shingles, at most 3 differing bits."""
    found = simhash.simhash_components(read(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text they decode to, as digests."""
    path = public_path(WORD_BPE)
    return digests(bpe.bpe_decode(bpe.bpe_encode(read(spark, sf_dir, "documents"), path), path))


def digests(decoded: DataFrame, *more: str) -> DataFrame:
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          sha(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"), *more)


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and lattice score of every document."""
    pieces, logp = lattice.sentencepiece_scores(public_path(PIECE_BPE))
    return lattice.lm_scores(read(spark, sf_dir, "documents"), pieces, logp)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, the plain rules and the verdict of the robust distance."""
    return quality.quality_rules(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy longest-match pieces of every document."""
    vocabulary = token_counts.sentencepiece_vocabulary(public_path(PIECE_BPE))
    return token_counts.token_counts(read(spark, sf_dir, "documents"), vocabulary)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by a model fitted to labelled rows that are not held out."""
    docs = read(spark, sf_dir, "documents")
    found = toxicity.toxicity_scores(docs, toxicity.fit_toxicity(docs, read(spark, sf_dir, "labels")))
    held_out = ~F.coalesce(toxicity.training_row(), F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic",
                        F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("offsets"))


def _crc(batches):
    for b in batches:
        ids, at = np.asarray(b.column("ids").flatten()).astype("<u4"), np.cumsum(pc.list_value_length(b.column("ids")))
        n = np.diff(at, prepend=0)
        crc = [zlib.crc32(ids[end - k: end].tobytes()) for k, end in zip(n.tolist(), at.tolist())]
        yield pa.record_batch([b.column("doc_id"), b.column("start"), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                              ["doc_id", "start", "n_tokens", "ids_crc32"])


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as token files, read the files back and digest each document."""
    folder = shared_folder(spark, "token-files")
    files = token_files.write_token_files(read(spark, sf_dir, "documents"), folder, public_path(WORD_BPE), end_id=2)
    return token_files.read_token_files(folder, files).mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: spans of the plain patterns, and of high entropy."""
    found = secret_scan.secret_spans(read(spark, sf_dir, "documents"))

    def of(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda x: x["place"] < len(secret_scan.BASE))
    return found.select("doc_id", *(of(kind).alias(f"n_{kind}") for kind in secret_scan.BASE), sha(secret_scan.span_list(base)).alias("base_sha256"), secret_scan.span_list(F.col("spans")).alias("spans"))


def with_cycles(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: of every tenth document (by the checksum of its id; none of a null id), the words from one place on repeat a first part of them."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), h.alias("h"))
    got = got.select("doc_id", "text", F.floor(F.col("h") / 10).alias("g"), F.array_remove(F.split(F.when(F.col("h") % 10 == 0, F.col("text")), WHITE), "").alias("words"))
    got = got.withColumn("n", F.when(F.size("words") > 0, F.size("words")))  # null: stays as it is
    got = got.withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    got = got.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    cycle = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    return got.select("doc_id", F.coalesce(F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), cycle), " "), F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words in every document, after a tenth of them were made periodic, and the texts without repeats."""
    found = runs.periodic_runs(with_cycles(read(spark, sf_dir, "documents")), least=24, times=3)
    best = found.withColumn("best", runs.longest_power(F.col("runs")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    milli = F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long")
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"),
                       sha(listed).alias("runs_sha256"), sha(F.col("text")).alias("collapsed_sha256"), "n_words")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with faults, by the checksum of ``conv_id:turn`` (null: one space): dropped, emptied, without ends, twice, or by the user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    got = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return got.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("one")).drop("one")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, their faults, and the cheapest repair with its digest."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    repairs, repaired = repair.repair_conversations(damaged(rows))
    key = repair.conversation_key(F.col("conv_id"))
    every = rows.select("conv_id", key.alias("conv")).distinct()
    got = every.join(repairs.withColumn("conv", key).drop("conv_id"), "conv", "left").join(repair.conversation_digests(repaired), "conv", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return got.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", sha(F.lit(""))).alias("repaired_sha256"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_chat_format": op3_chat_format,
    "op4_simhash": op4_simhash,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_lm_scores": op6_lm_scores,
    "op7_quality": op7_quality,
    "op8_token_counts": op8_token_counts,
    "op9_toxicity": op9_toxicity,
    "op10_token_files": op10_token_files,
    "op11_secret_scan": op11_secret_scan,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLE: dict[str, str] = {}

ORACLE["op1_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 20)) AS p FROM late),
word AS (SELECT doc_id, p, w[p] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

WORDS2 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE["op2_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {WORDS2} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {WORDS2} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, s)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, i + unnest(range(0, n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLE["op3_chat_format"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, n, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       sum(length(regexp_replace(role, '([\\#<:])', 'x\1', 'g')) + length(regexp_replace(text, '([\\#<])', 'x\1', 'g')) + 14)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


def sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def secret_scan_sql() -> str:
    """Matches placed by the texts between them; entropy counted anew in every window."""
    classes = secret_scan.CLASSES
    patterns = [*secret_scan.BASE.items(), *((c.kind, f"{secret_scan.letter_class(c)}{{{c.window},}}") for c in classes)]
    found = " UNION ALL ".join(f"SELECT doc_id, {k} AS place, '{kind}' AS kind, regexp_extract_all(t, {sql_text(p)}) AS f, string_split_regex(t, {sql_text(p)}) AS g FROM d"
                               for k, (kind, p) in enumerate(patterns))
    kinds = ", ".join(f"('{c.kind}', {c.window}, {secret_scan.weight_limit(c)})" for c in classes)
    allowed = " OR ".join(f"regexp_matches(s, {sql_text(p)})" for p in secret_scan.ALLOWED)
    key = sql_text("^" + secret_scan.KEY)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
one AS (SELECT doc_id, place, kind, unnest(range(len(f))) AS i, unnest(f) AS s, unnest(g[1:len(f)]) AS gap FROM found WHERE len(f) > 0),
placed AS (SELECT doc_id, place, kind, i, s, sum(length(gap) + length(s)) OVER (PARTITION BY doc_id, place ORDER BY i) - length(s) AS a FROM one),
base AS (SELECT doc_id, place, kind, a AS s, a + length(s) AS e FROM placed WHERE place IN (1, 2) OR (place = 0 AND length(regexp_replace(s, {key}, '')) >= {secret_scan.LEAST_VALUE})),
class(kind, w, most) AS (VALUES {kinds}),
win AS (SELECT doc_id, place, kind, w, most, a + j AS a, substr(s, j + 1, w) AS x
        FROM (SELECT *, unnest(range(length(s) - w + 1)) AS j FROM placed JOIN class USING (kind) WHERE NOT ({allowed}))),
cnt AS (SELECT doc_id, place, kind, w, most, a, c, count(*) AS n FROM (SELECT doc_id, place, kind, w, most, a, unnest(string_split(x, '')) AS c FROM win) GROUP BY ALL),
hot AS (SELECT doc_id, place, kind, w, a FROM cnt GROUP BY doc_id, place, kind, w, most, a HAVING sum({secret_scan.WEIGHTS}[n + 1]) <= most),
grp AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, place ORDER BY a) AS g
        FROM (SELECT *, CASE WHEN a <= lag(a) OVER (PARTITION BY doc_id, place ORDER BY a) + w THEN 0 ELSE 1 END AS new FROM hot)),
every AS (SELECT * FROM base UNION ALL SELECT doc_id, place, kind, min(a), max(a) + any_value(w) FROM grp GROUP BY doc_id, place, kind, g)
SELECT doc_id, count(*) FILTER (WHERE place = 0) AS n_assign, count(*) FILTER (WHERE place = 1) AS n_access, count(*) FILTER (WHERE place = 2) AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, place) FILTER (WHERE place < 3), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, place), '') AS spans
FROM d LEFT JOIN every USING (doc_id) GROUP BY doc_id
"""


ORACLE["op11_secret_scan"] = secret_scan_sql()


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit (the reflected polynomial is a fixed value)."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN e >= 0 THEN xor(c, e) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, e: {step}), 4294967295)"


ORACLE["op12_periodic_runs"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {crc32_sql('doc_id::VARCHAR')} AS h FROM documents),
c AS (SELECT *, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS hot, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM c),
x AS (SELECT doc_id, n, CASE WHEN hot THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM p),
tok AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS t FROM x),
eq AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND a.t = b.t AND b.i > a.i WHERE 3 * (b.i - a.i) <= a.n),
isl AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l
        FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM eq) GROUP BY doc_id, q, g),
run AS (SELECT doc_id, s, l, min(q) AS q FROM isl WHERE l >= greatest(24, 3 * q) GROUP BY doc_id, s, l),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l::DOUBLE / q DESC, s, q) = 1),
lst AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS t FROM tok ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, l::BIGINT AS length, q::BIGINT AS period, (1000 * l // q)::BIGINT AS exponent_milli,
       sha256(coalesce(lst.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256, n::BIGINT AS n_words
FROM x LEFT JOIN best USING (doc_id) LEFT JOIN lst USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLE["op13_conversation_repair"] = rf"""
WITH RECURSIVE src AS (SELECT coalesce(conv_id::VARCHAR, ' ') AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
       {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
dam AS (SELECT k, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM src WHERE kind <> 0),
ord AS (SELECT *, left(role, 1) AS x, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
        row_number() OVER (PARTITION BY k, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
        NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS short FROM dam),
f AS (SELECT k, turn, role, text, x, i, blank, again AND NOT blank AS dup, short AND NOT again AND NOT blank AS trunc, lag(x) OVER (PARTITION BY k ORDER BY i) AS before FROM ord),
stat AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(dup) AS duplicate, count_if(trunc) AS truncated,
         count_if(i > 1 AND before || '>' || x NOT IN ('s>u', 'u>a', 'a>u')) AS illegal, count(*) AS n FROM f GROUP BY k),
nxt(q, r, z) AS (VALUES ('0', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
ins AS (SELECT q, q AS r, 0 AS c, '' AS l FROM nxt UNION ALL SELECT q, r, 5, 'I' FROM nxt UNION ALL SELECT a.q, b.r, 10, 'II' FROM nxt a JOIN nxt b ON a.r = b.q),
walk AS (SELECT k, 0::BIGINT AS i, '0' AS q, {{'c': 0, 'l': ''}} AS w FROM stat
  UNION ALL
  SELECT k, i, q, min(w) AS w FROM (
    SELECT w.k, f.i, e.q, {{'c': w.w.c + ins.c + e.c, 'l': w.w.l || ins.l || e.l}} AS w
    FROM walk w JOIN ins ON ins.q = w.q JOIN f ON f.k = w.k AND f.i = w.i + 1 JOIN nxt ON nxt.q = ins.r,
    LATERAL (SELECT ins.r AS q, 2 AS c, 'D' AS l
             UNION ALL SELECT nxt.r, 1 + CASE WHEN f.trunc THEN 5 ELSE 0 END, 'R' WHERE NOT f.blank AND NOT f.dup
             UNION ALL SELECT f.x, CASE WHEN f.trunc THEN 5 ELSE 0 END, 'K' WHERE NOT f.blank AND NOT f.dup AND (f.x = nxt.z OR (f.x = 's' AND ins.r = '0'))) e)
  GROUP BY k, i, q),
best AS (SELECT k, min({{'c': w.c + ins.c, 'l': w.l || ins.l}}) AS w FROM walk JOIN stat USING (k) JOIN ins ON ins.q = walk.q WHERE i = n AND ins.r IN ('0', 'a') GROUP BY k),
let AS (SELECT k, unnest(range(1, length(w.l) + 1)) AS j, unnest(string_split(w.l, '')) AS l, (length(w.l) - length(replace(w.l, 'D', ''))) % 2 AS odd FROM best WHERE w.l <> ''),
num AS (SELECT *, count_if(l <> 'I') OVER (PARTITION BY k ORDER BY j) AS i, count_if(l <> 'D') OVER (PARTITION BY k ORDER BY j) - 1 AS o,
        count_if(l <> 'D') OVER (PARTITION BY k) % 2 AS s FROM let),
lines AS (SELECT num.k, j, CASE WHEN l = 'K' THEN f.role WHEN (o - s) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN l = 'I' THEN '' ELSE f.text END AS t
          FROM num LEFT JOIN f ON f.k = num.k AND f.i = num.i WHERE l <> 'D'),
rep AS (SELECT k, string_agg(t, chr(10) ORDER BY j) AS t FROM lines GROUP BY k)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.w.c, 0)::BIGINT AS cost, coalesce(best.w.l, '') AS audit, sha256(coalesce(rep.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS k FROM conversations) LEFT JOIN stat USING (k) LEFT JOIN best USING (k) LEFT JOIN rep USING (k)
"""
