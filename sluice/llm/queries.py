"""The registered queries of this subpackage, thin layers over its operators, and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, divergence, embedding_dedup, licenses, lp_packing, near_dedup, packing, pii, quality, structure_repair, substring_dedup, token_files
from ._runtime import Scratch, finished, table

WORD_SPLIT = r"[\x20\x09-\x0D]+"


def tokenizer_path() -> str:
    """The public tokenizer that the contract names; its path is a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    return finished(near_dedup.near_duplicates(table(spark, sf_dir, "documents"), scratch), scratch)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    found = pii.find_pii(table(spark, sf_dir, "documents"), scratch)

    def spelled(kind, span):
        return F.concat_ws(":", kind, span["start"].cast("string"), span["end"].cast("string"))

    base = F.array_join(F.transform("base", lambda b: spelled(F.element_at(F.array(*map(F.lit, pii.KINDS)), b["kind"] + 1), b)), ",")
    every = F.concat(
        F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"))),
        F.transform(F.coalesce("learned", F.array().cast("array<struct<start:int,end:int>>")), lambda s: F.struct(s["start"].alias("start"), F.lit(len(pii.KINDS)).alias("kind"), s["end"].alias("end"))),
    )
    spans = F.array_join(F.transform(F.sort_array(every), lambda b: spelled(F.element_at(F.array(*map(F.lit, (*pii.KINDS, pii.LEARNED))), b["kind"] + 1), b)), ",")
    counts = [F.expr(f"size(filter(base, b -> b.kind = {k}))").cast("long").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    result = found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"), F.coalesce(F.size("learned"), F.lit(0)).cast("long").alias("n_id"), F.size(every).cast("long").alias("n_spans"))
    return finished(result, scratch)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    formatted = chat_format.format_conversations(turns.unionByName(extra), tokenizer_path())

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a conversation, whose windows come one after the other."""
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
        whole = loss = current = None
        n = said = size = number = 0
        for batch in batches:
            rows = []
            for conv, text, n_context, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if whole is None or conv != current:
                    if whole is not None:
                        rows.append((current, n, whole.hexdigest(), said, loss.hexdigest(), size, number))
                    current, whole, loss, n, said, size, number = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
                size, number = size + len(text), number + 1
                for role, turn in chat_format.read_window(text)[n_context:]:
                    whole.update(f"{role}\n{turn}\n".encode())
                    n += 1
                for span in spans:
                    own = chat_format.unescape(text[span["start"] : span["end"]])
                    loss.update(own.encode())
                    said += len(own)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        if whole is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((current, n, whole.hexdigest(), said, loss.hexdigest(), size, number), kinds, strict=True)], names=names)

    return formatted.select("conv_id", "text", "n_context", "loss").mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), scratch)
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), WORD_SPLIT, " "))
    return finished(kept.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256")), scratch)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    folder = scratch.path()
    manifest = token_files.write_token_files(docs, folder, tokenizer_path())
    return finished(token_files.read_token_files(manifest, folder).select("doc_id", "start", "n_tokens", "ids_crc32"), scratch)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return q.select("doc_id", *(f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()).drop("class_size")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    return finished(embedding_dedup.near_embeddings(table(spark, sf_dir, "embeddings"), scratch), scratch)


def damaged(turns: DataFrame) -> DataFrame:
    """The contract's damage: of twenty rows one is dropped, one emptied, one loses its sentence marks, one is repeated, one becomes a user's."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    rows = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.expr("if(kind = 3, array(1, 2), array(1))"))).drop("col")


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    schema = ", ".join(f"{c} {'string' if c in names[7:] else 'long'}" for c in names)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a conversation, whose edits come one after the other."""
        kinds = [pa.string() if c in names[7:] else pa.int64() for c in names]
        whole, between = hashlib.sha256(), b""
        for batch in batches:
            rows = []
            for conv, edit, role, text, report in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if report is not None:
                    rows.append((conv, *report.values(), whole.hexdigest()))
                    whole, between = hashlib.sha256(), b""
                elif edit != "D":
                    whole.update(between + f"{role}:{text}".encode())
                    between = b"\n"
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    found = structure_repair.repair_conversations(damaged(turns)).mapInArrow(digest, schema)
    every = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    result = every.alias("c").join(found.alias("f"), F.col("c.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
    return result.select("c.conv_id", *(F.coalesce(f"f.{c}", F.lit(0)).alias(c) for c in names[1:7]), F.coalesce("f.audit", F.lit("")).alias("audit"), F.coalesce("f.repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op12_lp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    return finished(lp_packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), scratch), scratch)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    return finished(divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"), scratch), scratch)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_near_dedup, op2_pii, op3_chat_format, op4_substring_dedup, op5_token_files, op6_bpe, op7_quality, op8_packing, op9_licenses, op10_embedding_dedup, op11_structure_repair, op12_lp_packing, op13_divergence)
}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _fails(line: str) -> str:
    """``quality.line_fails`` in DuckDB's words."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    count = lambda pattern: f"len(regexp_extract_all({line}, {q(pattern)}))"
    words = count(r"[^\x20\x09-\x0D]+")
    phrases = f"len(regexp_extract_all(lower({line}), {q('|'.join(sorted(quality.BOILERPLATE, key=len, reverse=True)))}))"
    menu = f"^{quality.NOT_WORD}(?:{'|'.join(quality.MENU)}){quality.NOT_WORD}$"
    anyof = lambda s: "[" + "".join("\\" + c if c in "\\]^" else c for c in s) + "]"
    end = anyof(quality.CLOSING) + r"[\x20\t-\r]*$"
    separators = count(anyof(quality.SEPARATORS))
    return f"""(({phrases} > 0 AND {words} < {quality.PHRASE_WORDS} * {phrases}) OR ({separators} >= 2 AND {words} < {quality.SEPARATOR_WORDS} * {separators})
      OR (contains({line}, '://') AND {words} <= 2 * {count('://')}) OR regexp_matches(lower({line}), {q(menu)})
      OR (NOT regexp_matches({line}, {q(end)}) AND {words} < {quality.SHORT_LINE_WORDS})
      OR {count(anyof(quality.LINE_SYMBOLS))} > {quality.MAX_LINE_SYMBOLS} * length({line}))"""


ORACLE: dict[str, str] = {
    "op4_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d),
        g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM p),
        f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM g JOIN f USING (g) WHERE doc_id > first),
        word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY k) AS t FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op7_quality": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        a AS (SELECT doc_id, text, {_WORDS} AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
        g AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM a)),
        r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS k FROM g JOIN (SELECT doc_id, g FROM g GROUP BY doc_id, g HAVING count(*) > 1) USING (doc_id, g)) GROUP BY doc_id),
        c AS (SELECT a.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                     CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                     CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
                     length(regexp_replace(array_to_string(list_filter(lines, lambda l: NOT {_fails("l")}), ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS good
              FROM a LEFT JOIN r ON a.doc_id = r.doc_id)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {int(100 * quality.MAX_REPEATED)} * n_words AS base_failed,
               NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {int(100 * quality.MAX_REPEATED)} * n_words) AND good >= {1 - quality.MAX_LOST} * word_chars AS kept
        FROM c""",
    "op10_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
        l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        c(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT c.x, l.y FROM c JOIN l ON c.y = l.x)
        SELECT e.vec_id, CAST((SELECT count(*) FROM l WHERE l.x = e.vec_id) AS BIGINT) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
        FROM embeddings e JOIN (SELECT x, min(y) AS component_id FROM c GROUP BY x) m ON m.x = e.vec_id""",
    "op11_structure_repair": """
        WITH RECURSIVE t AS (
            SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
        s AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                     list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)) AS key FROM conversations),
        k AS (SELECT s.*, xor(list_reduce(list_prepend(4294967295, key), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM s, t),
        d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                     CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM k, range(2) r(n) WHERE kind <> 0 AND (n = 0 OR kind = 3)),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
        f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
                          WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 3 ELSE 0 END AS fault FROM o),
        g AS (SELECT *, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS two FROM f),
        n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
                     count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows FROM g GROUP BY conv_id),
        e(edit) AS (VALUES ('K'), ('R'), ('D')),
        -- the best cost, audit and turns at each row and grammar state (0 start, 1 system, 2 user, 3 assistant); at most two turns are inserted before a row
        w(conv_id, i, state, best) AS (
            SELECT conv_id, CAST(0 AS BIGINT), 0, {'cost': CAST(0 AS BIGINT), 'audit': '', 'turns': CAST([] AS VARCHAR[])} FROM n
            UNION ALL
            SELECT conv_id, i, state, min(best) FROM (
                SELECT b.conv_id, g.i, CASE e.edit WHEN 'D' THEN b.state WHEN 'K' THEN CASE left(g.role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE b.state WHEN 2 THEN 3 ELSE 2 END END AS state,
                       {'cost': b.cost + CASE e.edit WHEN 'D' THEN 3 ELSE CASE e.edit WHEN 'R' THEN 2 ELSE 0 END + CASE g.fault WHEN 3 THEN 1 ELSE 0 END END, 'audit': b.audit || e.edit,
                        'turns': CASE e.edit WHEN 'D' THEN b.turns WHEN 'K' THEN list_append(b.turns, g.role || ':' || g.text)
                                 ELSE list_append(b.turns, CASE b.state WHEN 2 THEN 'assistant:' ELSE 'user:' END || g.text) END} AS best
                FROM (SELECT conv_id, i, CASE WHEN m = 0 THEN state WHEN (m = 1) = (state <> 2) THEN 2 ELSE 3 END AS state, best.cost + 2 * m AS cost, best.audit || repeat('I', m) AS audit,
                             list_concat(best.turns, (CASE WHEN state = 2 THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END)[:m]) AS turns FROM w, (VALUES (0), (1), (2)) v(m)) b
                JOIN g ON g.conv_id IS NOT DISTINCT FROM b.conv_id AND g.i = b.i + 1
                JOIN e ON e.edit = 'D' OR g.fault NOT IN (1, 2) AND (e.edit = 'R' OR (b.state IN (0, 1, 3) AND left(g.role, 1) = 'u') OR (b.state = 0 AND left(g.role, 1) = 's') OR (b.state = 2 AND left(g.role, 1) = 'a')))
            GROUP BY conv_id, i, state),
        z AS (SELECT w.conv_id, min({'cost': best.cost + CASE state WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END, 'audit': best.audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
                     'turns': list_concat(best.turns, CASE state WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE CAST([] AS VARCHAR[]) END)}) AS best
              FROM w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.rows = w.i GROUP BY w.conv_id)
        SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.turns, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id""",
    "op13_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        u AS (SELECT doc, lang, source, unnest(w) AS term FROM d),
        k AS (SELECT lang, term FROM u GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
        c AS (SELECT lang, source, term, count(*) AS n FROM u JOIN k USING (lang, term) GROUP BY lang, source, term),
        v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source),
        ln AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang),
        p AS (SELECT gn.lang, gn.source, k.term, coalesce(n, 0) AS n, 1 + 1000000000 * (coalesce(n, 0) + 2) // (gn.total + 2 * v) AS p
              FROM gn JOIN k ON k.lang = gn.lang JOIN v ON v.lang = gn.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
        q AS (SELECT c.lang, term, 1 + 1000000000 * (sum(n) + 2) // (any_value(total) + 2 * any_value(v)) AS q FROM c JOIN ln ON ln.lang = c.lang JOIN v ON v.lang = c.lang GROUP BY c.lang, term),
        f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        r AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
              FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN f ON f.lang = g.lang AND f.source = g.source AND f.item = h.source
              UNION ALL SELECT p.lang, source, 'term', p.term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q)
        SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r QUALIFY part = 'pair' OR rank <= 10""",
}
