"""Sign-up table: views, aggregates, searches and the changes a hosted table would make in place.

Sign-ups are stood in for by customers: place = nation, market segment = the name as typed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetrace.functions.scalars import html_escaped, pair_key, percent_change, pretty
from kinetrace.operators.relational import upsert
from kinetrace.plans.registry import Registry
from kinetrace.sources.keyed import KeyedTable
from kinetrace.sources.tables import load
from kinetrace.sources.work import new_folder

query = Registry()
SMALL_GROUP, PAGE, SUGGESTIONS = 3, 2000, 6

_SQL = """WITH s AS (
    SELECT c_custkey AS id, TIMESTAMP '2024-01-01' + (c_custkey * 7 % 10000) * INTERVAL 1 MINUTE AS created_at, c_name || '@Mail.org' AS email, c_name AS name,
        c_mktsegment AS typed, lower(c_mktsegment) || ' | ' || (c_nationkey % 5) AS gym_key, c_acctbal > 0 AS share,
        CASE WHEN c_custkey % 3 <> 0 THEN TIMESTAMP '2024-01-02' + c_custkey * INTERVAL 1 MINUTE END AS confirmed_at, CASE WHEN c_custkey % 4 = 0 THEN sha256(c_name) END AS token_hash
    FROM customer)"""


def signups(spark, sf_dir) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    minutes = lambda n: F.make_dt_interval(mins=n.cast("int"))
    return c.select(
        F.col("c_custkey").alias("id"),
        (F.lit("2024-01-01").cast("timestamp") + minutes(F.col("c_custkey") * 7 % 10000)).alias("created_at"),
        F.concat("c_name", F.lit("@Mail.org")).alias("email"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("typed"),
        F.concat(F.lower("c_mktsegment"), F.lit(" | "), (F.col("c_nationkey") % 5).cast("string")).alias("gym_key"),
        (F.col("c_acctbal") > 0).alias("share"),
        F.when(F.col("c_custkey") % 3 != 0, F.lit("2024-01-02").cast("timestamp") + minutes(F.col("c_custkey"))).alias("confirmed_at"),
        F.when(F.col("c_custkey") % 4 == 0, F.sha2("c_name", 256)).alias("token_hash"),
    )


def by_gym(rows: DataFrame) -> DataFrame:
    """Sign-ups by key: usual spelling (first in order on ties), counts, last sign-up, first names of those who agreed."""
    spelling = rows.groupBy("gym_key", "typed").agg(F.count(F.lit(1)).alias("n")).groupBy("gym_key").agg(F.min_by("typed", F.struct(-F.col("n"), F.col("typed"))).alias("gym"))
    shown = F.when(F.col("share") & F.col("confirmed_at").isNotNull(), F.struct("created_at", "id", F.split_part("name", F.lit("#"), F.lit(2)).alias("first")))
    sums = rows.groupBy("gym_key").agg(
        F.count(F.lit(1)).alias("signups"),
        F.count("confirmed_at").alias("confirmed"),
        F.max("created_at").alias("last_signup"),
        F.array_sort(F.collect_list(shown)).alias("f"),
    )
    names = F.nullif(F.array_join(F.transform("f", lambda x: x["first"]), ", "), F.lit(""))
    return sums.join(spelling, "gym_key").withColumn("names", names).drop("f")


def k_anonymous(count, least: int = SMALL_GROUP):
    return F.when(count >= least, count.cast("int"))


@query(
    _SQL
    + """, m AS (SELECT gym_key, typed, row_number() OVER (PARTITION BY gym_key ORDER BY count(*) DESC, typed) AS r FROM s GROUP BY gym_key, typed)
    SELECT s.gym_key, any_value(m.typed) AS gym, count(*) AS signups, count(confirmed_at) AS confirmed, max(created_at)::VARCHAR AS last_signup,
        sha256(coalesce(string_agg(split_part(name, '#', 2), ', ' ORDER BY created_at, id) FILTER (share AND confirmed_at IS NOT NULL), '')) AS names
    FROM s JOIN m ON m.gym_key = s.gym_key AND r = 1 GROUP BY s.gym_key"""
)
def gym_rollup(spark, sf_dir):
    g = by_gym(signups(spark, sf_dir))
    return g.select("gym_key", "gym", "signups", "confirmed", F.date_format("last_signup", "yyyy-MM-dd HH:mm:ss").alias("last_signup"), F.sha2(F.coalesce("names", F.lit("")), 256).alias("names"))


@query(
    _SQL
    + """, h AS (SELECT DISTINCT gym_key FROM s WHERE id % 97 = 0),
    g AS (SELECT gym_key, count(*) AS n FROM s GROUP BY gym_key) SELECT gym_key, CASE WHEN n >= 3 THEN n::INT END AS members FROM g WHERE gym_key NOT IN (SELECT gym_key FROM h)"""
)
def hidden_anti(spark, sf_dir):
    """Public counts without hidden gyms; small groups are suppressed."""
    s = signups(spark, sf_dir)
    hidden = s.where("id % 97 = 0").select("gym_key").distinct()
    groups = s.groupBy("gym_key").agg(F.count(F.lit(1)).alias("n"))
    return groups.join(hidden, "gym_key", "left_anti").select("gym_key", k_anonymous(F.col("n")).alias("members"))


@query(
    _SQL
    + """, g AS (SELECT gym_key AS gym, CASE WHEN count(*) >= 3 THEN count(*)::INT END AS members FROM s GROUP BY gym_key)
    SELECT gym, members FROM g ORDER BY members DESC NULLS LAST, gym LIMIT 2000"""
)
def suggestion_list(spark, sf_dir):
    some = signups(spark, sf_dir).groupBy(F.col("gym_key").alias("gym")).agg(F.count(F.lit(1)).alias("n"))
    return some.select("gym", k_anonymous(F.col("n")).alias("members")).orderBy(F.col("members").desc_nulls_last(), "gym").limit(PAGE)


@query(
    """WITH g AS (SELECT p_type AS name, count(*) AS members FROM part GROUP BY p_type),
    r AS (SELECT *, CASE WHEN starts_with(lower(name), 'st') THEN 0 WHEN contains(lower(name), ' st') THEN 1 WHEN contains(lower(name), 'st') THEN 2 END AS rank FROM g)
    SELECT name, members, rank::INT AS rank FROM r WHERE rank IS NOT NULL ORDER BY rank, members DESC, name LIMIT 6"""
)
def suggest_prefix(spark, sf_dir):
    """Names that begin with what was typed, then with a word that does, then that contain it."""
    names = load(spark, sf_dir, "part").groupBy(F.col("p_type").alias("name")).agg(F.count(F.lit(1)).alias("members"))
    low = F.lower("name")
    rank = F.when(low.startswith("st"), 0).when(F.contains(low, F.lit(" st")), 1).when(F.contains(low, F.lit("st")), 2)
    return names.withColumn("rank", rank).where("rank is not null").orderBy("rank", F.col("members").desc(), "name").limit(SUGGESTIONS)


@query(
    _SQL
    + """, n AS (SELECT id, email, gym_key, 'new ' || name AS name, NOT share AS share, NULL::TIMESTAMP AS confirmed_at, 'tok' || id AS token_hash, id % 2 = 0 AS mailed FROM s WHERE id % 5 = 0
        UNION ALL SELECT -id, 'x' || email, gym_key, name, share, NULL, 'tok' || id, true FROM s WHERE id % 50 = 0)
    SELECT coalesce(s.email, n.email) AS email, coalesce(s.gym_key, n.gym_key) AS gym_key, coalesce(n.name, s.name) AS name, coalesce(n.share, s.share) AS share,
        (s.confirmed_at IS NOT NULL) AS confirmed, CASE WHEN s.id IS NULL THEN n.token_hash WHEN n.id IS NULL THEN s.token_hash WHEN n.mailed THEN n.token_hash ELSE coalesce(s.token_hash, n.token_hash) END AS token_hash
    FROM s FULL JOIN n ON s.email = n.email AND s.gym_key = n.gym_key"""
)
def upsert_signup(spark, sf_dir):
    """New sign-ups merged by (email, key): the first confirmation stays, name and consent are replaced, the token if a mail goes out."""
    old, new = _batch(signups(spark, sf_dir))
    return _signed(upsert(old, new, ["email", "gym_key"], "created_at", _merge()))


def _merge() -> dict:
    return {
        "name": F.col("new.name"),
        "share": F.col("new.share"),
        "confirmed_at": F.coalesce(F.col("old.confirmed_at"), F.col("new.confirmed_at")),
        "token_hash": F.when(F.col("new.mailed"), F.col("new.token_hash")).otherwise(F.coalesce(F.col("old.token_hash"), F.col("new.token_hash"))),
    }


def _signed(rows: DataFrame) -> DataFrame:
    return rows.select("email", "gym_key", "name", "share", F.col("confirmed_at").isNotNull().alias("confirmed"), "token_hash")


def _batch(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sign-ups there are, and a batch of repeated and fresh ones."""
    again = s.where("id % 5 = 0").select(
        "email", "gym_key", F.concat(F.lit("new "), "name").alias("name"), (~F.col("share")).alias("share"), F.lit(None).cast("timestamp").alias("confirmed_at"),
        F.concat(F.lit("tok"), F.col("id").cast("string")).alias("token_hash"), (F.col("id") % 2 == 0).alias("mailed"), "created_at",
    )
    fresh = s.where("id % 50 = 0").select(
        F.concat(F.lit("x"), "email").alias("email"), "gym_key", "name", "share", F.lit(None).cast("timestamp").alias("confirmed_at"),
        F.concat(F.lit("tok"), F.col("id").cast("string")).alias("token_hash"), F.lit(True).alias("mailed"), "created_at",
    )
    return s.select("email", "gym_key", "name", "share", "confirmed_at", "token_hash"), again.unionByName(fresh)


_KEYED_SQL = """, n AS (SELECT id, email, gym_key, 'new ' || name AS name, NOT share AS share, 'tok' || id AS token_hash, id % 2 = 0 AS mailed FROM s WHERE id % 5 = 0
        UNION ALL SELECT -id, 'x' || email, gym_key, name, share, 'tok' || id, true FROM s WHERE id % 50 = 0),
    m AS (SELECT coalesce(s.email, n.email) AS email, coalesce(s.gym_key, n.gym_key) AS gym_key, coalesce(n.name, s.name) AS name, coalesce(n.share, s.share) AS share, s.id AS id,
        (s.confirmed_at IS NOT NULL) AS confirmed, CASE WHEN s.id IS NULL THEN n.token_hash WHEN n.id IS NULL THEN s.token_hash WHEN n.mailed THEN n.token_hash ELSE coalesce(s.token_hash, n.token_hash) END AS token_hash
        FROM s FULL JOIN n ON s.email = n.email AND s.gym_key = n.gym_key)"""


@query(_SQL + _KEYED_SQL + " SELECT email, gym_key, name, share, confirmed OR coalesce(id % 8 = 3, false) AS confirmed, token_hash FROM m WHERE NOT coalesce(id % 13 = 0, false)")
def keyed_changes(spark, sf_dir):
    """Sign-ups in a table by key, after a batch was merged in, some were confirmed and some deleted; each change rewrites the buckets it touches."""
    s = signups(spark, sf_dir)
    old, new = _batch(s)
    signed = KeyedTable(spark, new_folder(spark, "signups"), ["email", "gym_key"], int(spark.conf.get("spark.sql.shuffle.partitions")))
    signed.create(old)
    signed.upsert(new, "created_at", _merge())
    at = F.coalesce("confirmed_at", F.lit("2024-03-01").cast("timestamp"))
    signed.update(s.where("id % 8 = 3").select("email", "gym_key"), {"confirmed_at": at})
    signed.delete(s.where("id % 13 = 0").select("email", "gym_key"))
    return _signed(signed.read())


@query(
    _SQL
    + """, e AS (SELECT email FROM s WHERE token_hash = sha256('Customer#000000016') OR id = 8) SELECT id, TIMESTAMP '2024-03-01'::VARCHAR AS confirmed_at FROM s WHERE email IN (SELECT email FROM e) AND confirmed_at IS NULL
    UNION ALL SELECT id, confirmed_at::VARCHAR FROM s WHERE email IN (SELECT email FROM e) AND confirmed_at IS NOT NULL"""
)
def confirm_returning(spark, sf_dir):
    """All sign-ups of the address behind a token, confirmed now unless they were."""
    s = signups(spark, sf_dir)
    address = s.where((F.col("token_hash") == F.sha2(F.lit("Customer#000000016"), 256)) | (F.col("id") == 8)).select("email")
    at = F.coalesce("confirmed_at", F.lit("2024-03-01").cast("timestamp"))
    return s.join(address, "email", "left_semi").select("id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("confirmed_at"))


@query(_SQL + " SELECT gym_key, count(*) AS n, count(token_hash) AS tokens FROM s WHERE id % 13 <> 0 GROUP BY gym_key")
def delete_rewrite(spark, sf_dir):
    """What is left after a delete, which rewrites the table without the rows."""
    s = signups(spark, sf_dir)
    left = s.join(s.where("id % 13 = 0").select("id"), "id", "left_anti")
    return left.groupBy("gym_key").agg(F.count(F.lit(1)).alias("n"), F.count("token_hash").alias("tokens"))


@query(
    _SQL
    + """ SELECT gym_key, bool_or(confirmed_at IS NOT NULL) AS any_confirmed, coalesce(bool_or(created_at > TIMESTAMP '2024-01-07' - INTERVAL 10 MINUTE AND created_at <= TIMESTAMP '2024-01-07'), false) AS mailed_lately,
    count(*) FILTER (confirmed_at IS NOT NULL) AS confirmed FROM s GROUP BY gym_key"""
)
def address_status(spark, sf_dir):
    now = F.lit("2024-01-07").cast("timestamp")
    late = (F.col("created_at") > now - F.expr("INTERVAL 10 MINUTES")) & (F.col("created_at") <= now)
    known = F.col("confirmed_at").isNotNull()
    return signups(spark, sf_dir).groupBy("gym_key").agg(F.bool_or(known).alias("any_confirmed"), F.coalesce(F.bool_or(late), F.lit(False)).alias("mailed_lately"), F.count_if(known).alias("confirmed"))


@query(
    """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 = 0 THEN 'bot' WHEN length(trim(s_name)) = 0 THEN 'name' WHEN NOT regexp_full_match(s_name || '@x.org', '[^@[:space:]]+@[^@[:space:]]+\\.[^@[:space:]]+') THEN 'email' END AS reason,
    left(regexp_replace(trim('  ' || s_name || '   b '), '\\s+', ' ', 'g'), 12) AS name FROM supplier"""
)
def signup_validation(spark, sf_dir):
    """Honeypot, required fields, address pattern; the reason of refusal is a column."""
    s = load(spark, sf_dir, "supplier")
    raw = F.concat(F.lit("  "), "s_name", F.lit("   b "))
    name = F.left(F.regexp_replace(F.trim(raw), r"\s+", " "), F.lit(12))
    address = F.concat("s_name", F.lit("@x.org"))
    reason = F.when(F.col("s_suppkey") % 7 == 0, "bot").when(F.length(F.trim("s_name")) == 0, "name").when(~F.rlike(address, F.lit(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")), "email")
    return s.select(F.col("s_suppkey").alias("id"), reason.alias("reason"), name.alias("name"))


@query(
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[''’]', '', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')) AS key FROM documents"""
)
def text_keys(spark, sf_dir):
    """Search keys of whole texts: accents, case, apostrophes and signs do not matter."""
    from kinetrace.functions.scalars import text_key

    return load(spark, sf_dir, "documents").select("doc_id", text_key(F.col("text")).alias("key"))


@query("""SELECT item_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html FROM benchmark""")
def html_texts(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select("item_id", html_escaped(F.col("text")).alias("html"))


@query(
    """SELECT DISTINCT p_type AS name, upper(left(lower(p_type), 1)) || substr(lower(p_type), 2) AS label, replace(lower(p_type), ' ', '_') AS id FROM part"""
)
def exercise_names(spark, sf_dir):
    from kinetrace.functions.scalars import exercise_id

    return load(spark, sf_dir, "part").select(F.col("p_type").alias("name")).distinct().select("name", pretty(F.col("name")).alias("label"), exercise_id(F.col("name")).alias("id"))


@query(
    """WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, count(*) AS n FROM orders GROUP BY 1)
    SELECT strftime(month, '%Y-%m') AS month, n, coalesce(floor(100.0 * (n - lag(n) OVER (ORDER BY month)) / nullif(lag(n) OVER (ORDER BY month), 0) + 0.5)::BIGINT, 0) AS change FROM m"""
)
def monthly_change(spark, sf_dir):
    """Rounded percent change to the month before; the window is over a row per month."""
    months = load(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    before = F.lag("n").over(Window.orderBy("month"))
    return months.withColumn("b", before).select(F.date_format("month", "yyyy-MM").alias("month"), "n", F.coalesce(percent_change(F.col("n"), F.col("b")), F.lit(0).cast("long")).alias("change"))


def create_views(spark, signups: DataFrame, hidden: DataFrame) -> None:
    """The two aggregate views over given tables."""
    by_gym(signups).createOrReplaceTempView("waitlist_by_gym")
    groups = signups.groupBy("gym_key").agg(F.count(F.lit(1)).alias("n")).join(hidden, "gym_key", "left_anti")
    groups.select("gym_key", k_anonymous(F.col("n")).alias("members")).createOrReplaceTempView("waitlist_public")


__all__ = ["by_gym", "create_views", "k_anonymous", "pair_key", "query", "signups"]
