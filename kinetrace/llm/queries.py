"""The registered queries of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import chat_report, chat_windows
from .common import Workspace, table
from .exact import equal_texts
from .html_extract import extract_pages
from .language import fit_documents, language_report
from .media import media_report
from .minhash import near_duplicates
from .packing import pack_documents
from .periodic import run_report
from .phrases import collocations
from .pieces import piece_report
from .pii import personal_data_report
from .token_file import read_token_file, write_token_file
from .toxicity import toxicity_report


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents. Null and wordless texts have no shingles and link with nothing; equal texts are one group."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents. Null and empty texts score as a text without any feature; equal texts score alike."""
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of all texts and whether they decode to the text. A null text counts as empty and has no pieces."""
    return piece_report(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages. A null or empty page has empty text; broken markup is read as far as it goes."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_pages(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts stored as containers and read back, with codec, duration and keyframes. A null text counts as empty: one block of zeros."""
    return media_report(table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans and scores of personal data in all texts. Null and empty texts have none."""
    return personal_data_report(table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, read back from their formatted windows. A null text counts as empty; turns of one number go by role and text."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    spoken = "'</s>[INST] ok [/INST]' AS text"
    extra = spark.sql(f"SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, {spoken} UNION ALL SELECT -7L, 1L, 'assistant', {spoken}")
    return chat_report(chat_windows(turns.unionByName(extra)))


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to a token file and read back. A null text counts as empty and has its end id only; rows of one id go by their text."""
    folder = Workspace(spark, "token-file").path("ids")
    write_token_file(table(spark, sf_dir, "documents"), folder, vocabulary("word_bpe_49k.json"))
    return read_token_file(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096. A null text counts as empty and has its end id only; repeated rows are packed like any others."""
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all documents. A null text counts as empty, and empty texts are equal; of rows of one text and id one stays."""
    return equal_texts(table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best phrases of each language of all documents. A null text counts as empty, a null language as und; repeated rows count each time."""
    return collocations(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words of all documents. Null and empty texts have none; repeated rows give equal rows."""
    return run_report(table(spark, sf_dir, "documents"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents. Null texts and those without a letter are und; equal texts get equal results."""
    docs = table(spark, sf_dir, "documents")
    return language_report(docs, fit_documents(docs))


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_minhash_near_dedup, op2_toxicity, op3_sentencepiece, op4_html_extraction, op5_media_columns, op6_personal_data, op7_chat_formatting,
        op8_token_file, op9_best_fit_packing, op10_exact_dedup, op11_phrase_collocations, op12_periodic_runs, op13_language_id,
    )}


_NORMAL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op1_minhash_near_dedup": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex({_NORMAL}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
        e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
        c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
        SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c ON s.doc_id = c.a""",
    "op7_chat_formatting": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        p AS (
            SELECT *, 4 + ceil(strlen(text) / 4.0)::BIGINT AS cost,
                CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 11 ELSE 14 + length(role) END
                + length(text) + 4 * (length(text) - length(replace(text, '&', ''))) + 3 * len(regexp_extract_all(text, '</?s>'))
                + 4 * len(regexp_extract_all(text, '\[/?(?:SYS|INST|OUT|ROLE)')) AS size,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
        u AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM p),
        c AS (SELECT *, (upto - 1)::BIGINT // 512 AS cell FROM u),
        k AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY cell) AS own, max(upto) OVER (PARTITION BY conv_id, cell) AS reached FROM c),
        l AS (SELECT *, max(own) OVER (PARTITION BY conv_id) AS last FROM k),
        n AS (
            SELECT *, CASE WHEN own < last AND i = 1 AND role = 'system' THEN 1 + last - own
                WHEN own < last AND reached - upto + cost <= 256 THEN 2 ELSE 1 END AS times FROM l)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
            (sum(size * times) + 7 * max(last))::BIGINT AS formatted_chars
        FROM n GROUP BY conv_id""",
    "op10_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {_NORMAL} AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
        FROM n JOIN g ON n.t = g.t""",
    "op11_phrase_collocations": f"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_NORMAL}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
        o AS (
            SELECT lang, unnest(flatten(list_transform([1, 2, 3, 4],
                lambda k: list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))))) AS g FROM w),
        f AS (SELECT lang, g, count(*) AS f FROM o GROUP BY lang, g),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE NOT contains(g, ' ') GROUP BY lang),
        c AS (SELECT lang, g, f AS a, string_split(g, ' ') AS w FROM f WHERE f >= 30 AND contains(g, ' ')),
        k AS (SELECT lang, g, a, w, unnest(range(1, len(w))) AS k FROM c),
        s AS (
            SELECT k.lang, k.g, k.a, k.k, l.f AS l, r.f AS r, (2000000::HUGEINT * k.a) // (l.f::HUGEINT + r.f) AS score FROM k
            JOIN f l ON l.lang = k.lang AND l.g = array_to_string(k.w[1:k.k], ' ')
            JOIN f r ON r.lang = k.lang AND r.g = array_to_string(k.w[k.k + 1:], ' ')),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
        i AS (
            SELECT lang, a, unnest(flatten(list_transform(range(2, len(w)),
                lambda m: list_transform(range(1, len(w) - m + 2), lambda j: array_to_string(w[j:j + m - 1], ' '))))) AS g FROM c WHERE len(w) > 2),
        m AS (SELECT lang, g, max(a) AS longer FROM i GROUP BY lang, g)
        SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.g) AS rank,
            b.g AS phrase, b.a, b.l, b.r, n.n, b.score::BIGINT AS score
        FROM b JOIN n ON n.lang = b.lang LEFT JOIN m ON m.lang = b.lang AND m.g = b.g
        WHERE m.longer IS NULL OR 100::HUGEINT * m.longer < 80::HUGEINT * b.a QUALIFY rank <= 2000""",
    "op12_periodic_runs": """
        WITH h AS (
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
                xor(list_reduce(flatten([[4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
                    lambda c: list_transform(range(8), lambda b: (ascii(c) >> b::INT)::BIGINT & 1)))]),
                    lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) AS h
            FROM documents),
        g AS (
            SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS looped,
                CASE WHEN len(w) > 0 THEN h // 10 % len(w) END AS a, 3 + h // 10 % 8 AS times FROM h),
        d AS (
            SELECT row_number() OVER () AS row, doc_id, n, CASE WHEN looped
                THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // times) END]) ELSE w END AS w FROM g),
        x AS (SELECT row, n, unnest(w) AS word, unnest(range(n)) AS i FROM d),
        e AS (
            SELECT a.row, b.i - a.i AS q, a.i FROM x a JOIN x b ON a.row = b.row AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
        r AS (SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS isle FROM e),
        s AS (
            SELECT row, q, min(i) AS start, count(*) + q AS length FROM r GROUP BY row, q, isle
            HAVING count(*) + q >= greatest(6, 4 * q)),
        u AS (SELECT row, start, length, min(q) AS period FROM s GROUP BY row, start, length),
        t AS (
            SELECT row, count(*) AS n_runs, min((-length, start, period)) AS best,
                string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM u GROUP BY row),
        z AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM u),
        y AS (SELECT x.row, string_agg(x.word, ' ' ORDER BY x.i) AS kept FROM x ANTI JOIN z ON x.row = z.row AND x.i = z.i GROUP BY x.row)
        SELECT d.doc_id, coalesce(t.n_runs, 0) AS n_runs, t.best[2] AS start, -t.best[1] AS length, t.best[3] AS period,
            1000 * -t.best[1] // t.best[3] AS exponent_milli, sha256(coalesce(t.lines, '')) AS runs_sha256, sha256(coalesce(y.kept, '')) AS collapsed_sha256
        FROM d LEFT JOIN t ON d.row = t.row LEFT JOIN y ON d.row = y.row""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
