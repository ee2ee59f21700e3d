"""Queries over provisioning, tokens, sessions, job kinds, names, durations and cron days, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import accounts as ac
from ..operators import events as ev
from ..operators import queue as q
from ..operators import schedule as sd
from . import accounts as aq
from . import adapters as ad
from . import queue as qq
from .registry import registry

QUERIES, SQL, query = registry()
U, Q = ad.USERS_SQL, ad.QUEUE_SQL
C = "customer"


def now():
    return F.lit("1998-06-01 00:00:00").cast("timestamp_ntz")


AT = "TIMESTAMP '1998-06-01 00:00:00'"
CLAIMS = "cl AS (SELECT c_custkey id, CASE WHEN c_custkey % 13 <> 0 THEN c_custkey % 7 <> 0 END kid, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ['live'] ELSE ['live', 'music'] END aud, CASE WHEN c_custkey % 11 <> 0 THEN 1000 + (c_custkey % 9 - 4) * 30 END exp FROM customer)"


def claims(spark, d):
    k = F.col("c_custkey")
    aud = F.when(k % 5 == 1, F.array(F.lit("live"))).when(k % 5 > 1, F.array(F.lit("live"), F.lit("music")))
    return ad.table(spark, d, C).select(k.alias("id"), F.when(k % 13 != 0, k % 7 != 0).alias("kid"), aud.alias("aud"), F.when(k % 11 != 0, 1000 + (k % 9 - 4) * 30).alias("exp"))


VERDICT = "CASE WHEN kid IS NOT TRUE THEN 'unknown key' WHEN (exp + 60 > 1000) IS NOT TRUE THEN 'expired' WHEN list_contains(aud, 'music') IS NOT TRUE THEN 'wrong audience' ELSE 'ok' END"


def verdicts(spark, d):
    return claims(spark, d).withColumn("verdict", ac.claims_verdict(F.col("kid"), F.col("aud"), F.lit("music"), F.col("exp"), F.lit(1000)))


@query(f"WITH {CLAIMS} SELECT id, {VERDICT} verdict FROM cl")
def q217_token_claims(spark, d):
    return verdicts(spark, d).select("id", "verdict")


@query("WITH p AS (SELECT c_custkey id, CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'https://other' ELSE 'https://own' END iss, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 4 <> 0 END am, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 10 END exp FROM customer) SELECT id, CASE WHEN (iss = 'https://own') IS NOT TRUE THEN 'issuer mismatch' WHEN am IS NOT TRUE THEN 'audience mismatch' WHEN (exp > 5) IS NOT TRUE THEN 'expired' ELSE 'ok' END verdict FROM p")
def q217_provider_checks(spark, d):
    k = F.col("c_custkey")
    issuer = F.when(k % 6 == 1, "https://other").when(k % 6 > 1, "https://own")
    verdict = ac.provider_verdict(issuer, F.lit("https://own"), F.when(k % 7 != 0, k % 4 != 0), F.when(k % 5 != 0, k % 10), F.lit(5))
    return ad.table(spark, d, C).select(k.alias("id"), verdict.alias("verdict"))


@query("SELECT c_custkey id, coalesce(CASE c_custkey % 4 WHEN 0 THEN 'music' WHEN 1 THEN 'live' WHEN 2 THEN 'studio' END IN ('music', 'live'), false) allowed FROM customer")
def q216_audiences(spark, d):
    k = F.col("c_custkey")
    aud = F.when(k % 4 == 0, "music").when(k % 4 == 1, "live").when(k % 4 == 2, "studio")
    return ad.table(spark, d, C).select(k.alias("id"), ac.allowed_audience(aud, ["music", "live"]).alias("allowed"))


CALLS = CLAIMS + f", ok AS (SELECT id FROM cl WHERE {VERDICT} = 'ok'), ca AS (SELECT o_orderkey call, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS token FROM orders)"


def called(spark, d, strict):
    calls = ad.table(spark, d, "orders").select(F.col("o_orderkey").alias("call"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("token"))
    tokens = verdicts(spark, d).select(F.col("id").alias("token"), F.col("id").alias("user_id"), "verdict")
    return ac.authenticated(calls, tokens, strict).select("call", "user_id")


@query(f"WITH {CALLS} SELECT call, id user_id FROM ca JOIN ok ON id = token")
def q218_strict_calls(spark, d):
    return called(spark, d, True)


@query(f"WITH {CALLS} SELECT call, id user_id FROM ca LEFT JOIN ok ON id = token")
def q218_optional_calls(spark, d):
    return called(spark, d, False)


IDENT = "idn AS (SELECT c_custkey user_id, provider, provider || c_custkey subject, DATE '1996-01-01' + CAST((c_custkey * length(provider)) % 97 AS INT) linked_at FROM customer, (VALUES ('apple'), ('google'), ('local')) p(provider) WHERE (c_custkey + length(provider)) % 3 <> 0)"


def identities(spark, d):
    rows = aq.identities(spark, d)
    at = F.date_add(F.lit("1996-01-01").cast("date"), (F.col("user_id") * F.length("provider") % 97).cast("int"))
    return rows.select("user_id", "provider", F.concat("provider", F.col("user_id").cast("string")).alias("subject"), at.alias("linked_at"))


@query(f"WITH {IDENT} SELECT user_id, array_to_string(list(provider ORDER BY linked_at, provider), ',') providers FROM idn GROUP BY user_id")
def q351_identities_by_link_time(spark, d):
    order = F.array_sort(F.collect_list(F.struct("linked_at", "provider")))
    return identities(spark, d).groupBy("user_id").agg(F.array_join(F.transform(order, lambda x: x["provider"]), ",").alias("providers"))


ASKS = "ak AS (SELECT 1000000 + o_orderkey id, CASE o_orderkey % 3 WHEN 0 THEN 'apple' WHEN 1 THEN 'google' ELSE 'local' END provider, o_custkey FROM orders), ask AS (SELECT id, provider, provider || o_custkey subject FROM ak)"


def asks(spark, d):
    k = F.col("o_orderkey")
    provider = F.when(k % 3 == 0, "apple").when(k % 3 == 1, "google").otherwise("local")
    return ad.table(spark, d, "orders").select((1_000_000 + k).alias("id"), provider.alias("provider"), F.concat(provider, F.col("o_custkey").cast("string")).alias("subject"))


@query(f"WITH {IDENT}, {ASKS}, on_ AS (SELECT provider, subject, min(id) id FROM ask GROUP BY ALL) SELECT o.provider, o.subject, coalesce(user_id, id) user_id, user_id IS NULL created FROM on_ o LEFT JOIN idn i ON i.provider = o.provider AND i.subject = o.subject")
def q416_resolved_accounts(spark, d):
    return ac.resolve_or_provision(identities(spark, d), asks(spark, d))


@query(f"WITH {ASKS}, nw AS (SELECT min(id) id FROM ask GROUP BY provider, subject) SELECT id, 1 AS version, 'global' scope, 'user' AS role FROM nw")
def q415_new_accounts(spark, d):
    once = asks(spark, d).groupBy("provider", "subject").agg(F.min("id").alias("id"))
    users, _, roles = ac.new_accounts(once, now())
    return users.join(roles, F.col("id") == F.col("user_id")).select("id", "version", "scope", "role")


LINK = IDENT + ", lk AS (SELECT DISTINCT c_custkey + c_custkey % 2 user_id, 'google' provider, 'google' || (c_custkey - c_custkey % 3) subject FROM customer), lo AS (SELECT lk.*, i.user_id own, min(lk.user_id) OVER (PARTITION BY lk.provider, lk.subject) f FROM lk LEFT JOIN idn i ON i.provider = lk.provider AND i.subject = lk.subject)"


@query(f"WITH {LINK} SELECT user_id, subject, CASE WHEN coalesce(own, f) <> user_id THEN 'already_exists' WHEN own IS NOT NULL THEN 'unchanged' ELSE 'linked' END outcome FROM lo")
def q416_link_outcomes(spark, d):
    k = F.col("c_custkey")
    links = ad.table(spark, d, C).select((k + k % 2).alias("user_id"), F.lit("google").alias("provider"), F.concat(F.lit("google"), (k - k % 3).cast("string")).alias("subject"))
    return ac.link(identities(spark, d), links, F.lit("1998-06-01").cast("date"))[1].select("user_id", "subject", "outcome")


RESET = "cr AS (SELECT c_custkey email, CASE WHEN c_custkey % 4 <> 0 THEN 'r' || c_custkey END reset_token, 1000 + c_custkey % 20 x FROM customer)"


@query(f"WITH {RESET} SELECT email, CASE WHEN email % 3 = 0 AND reset_token IS NOT NULL AND x > 1010 THEN 'new' || email ELSE 'old' END password_hash, CASE WHEN email % 3 = 0 AND x > 1010 THEN NULL ELSE reset_token END reset_token FROM cr")
def q414_reset_passwords(spark, d):
    k = F.col("c_custkey")
    rows = ad.table(spark, d, C).select(k.alias("email"), F.lit("old").alias("password_hash"), F.when(k % 4 != 0, F.concat(F.lit("r"), k.cast("string"))).alias("reset_token"), (1000 + k % 20).alias("reset_expires_at"))
    tries = ad.table(spark, d, C).where("c_custkey % 3 = 0").select(F.concat(F.lit("r"), k.cast("string")).alias("reset_token"), F.concat(F.lit("new"), k.cast("string")).alias("new_hash"))
    return ac.reset_passwords(rows, tries, F.lit(1010))[0].select("email", "password_hash", "reset_token")


@query(U + ", asked AS (SELECT o_orderkey, 'cust' || (o_custkey + o_orderkey % 3) handle_key FROM orders), ow AS (SELECT handle_key, min(id) owner_id FROM users WHERE handle_key IS NOT NULL GROUP BY 1) SELECT o_orderkey, owner_id, owner_id IS NULL available FROM asked LEFT JOIN ow USING (handle_key)")
def q313_handle_owners(spark, d):
    k = F.col("o_orderkey")
    asked = ad.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("cust"), (F.col("o_custkey") + k % 3).cast("string")).alias("handle_key"))
    owners = ad.users(spark, d).where("handle_key is not null").groupBy("handle_key").agg(F.min("id").alias("owner_id"))
    return asked.join(owners, "handle_key", "left").select("o_orderkey", "owner_id", F.col("owner_id").isNull().alias("available"))


JOBS = "jb AS (SELECT 20000000 + o_orderkey id, CASE o_orderkey % 3 WHEN 0 THEN 'verification_email' WHEN 1 THEN 'orphan_reap' ELSE 'unheard_of' END AS name FROM orders), sp(name, channel, attempts, base_s) AS (VALUES ('verification_email', 'auth.email', 5, 10), ('orphan_reap', 'user.reap', 3, 30))"


def jobs(spark, d):
    k = F.col("o_orderkey")
    name = F.when(k % 3 == 0, "verification_email").when(k % 3 == 1, "orphan_reap").otherwise("unheard_of")
    return ad.table(spark, d, "orders").select((20_000_000 + k).alias("id"), name.alias("name"), F.lit("{}").alias("payload"))


@query(f"WITH {JOBS} SELECT id, channel, attempts - 1 retries, base_s backoff_s FROM jb JOIN sp USING (name)")
def q314_planned_jobs(spark, d):
    return q.planned(jobs(spark, d), q.job_specs(spark)).select("id", "channel", "retries", "backoff_s")


@query(f"WITH {JOBS} SELECT id, channel, attempts, {AT} attempt_at, CAST(NULL AS BIGINT) after_id FROM jb JOIN sp USING (name)")
def q402_enqueued(spark, d):
    new = q.planned(jobs(spark, d), q.job_specs(spark))
    return q.insert(ad.messages(spark, d), ad.payloads(spark, d), new, now())[0].where("id >= 20000000").select("id", "channel", "attempts", "attempt_at", "after_id")


@query(Q + qq.DEAD + " SELECT count(*) moved FROM msgs JOIN payloads USING (id) WHERE attempt_at IS NULL AND attempts <= 0 AND id NOT IN (SELECT id FROM dead)")
def q330_moved(spark, d):
    return q.swept_count(ad.messages(spark, d), ad.payloads(spark, d), qq.dead_letters(spark, d))


@query("SELECT DISTINCT o_orderkey id FROM orders WHERE o_orderkey % 5 <> 0")
def q511_worker_batch(spark, d):
    claimed = ad.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return q.run_once(claimed.union(claimed.where("id % 2 = 0")), claimed.where("id % 5 = 0"))[0]


@query()
def q353_random_channels(spark, d):
    return q.active_channels(ad.messages(spark, d), now()).orderBy(F.rand(7)).limit(3)


@query("SELECT c_custkey, coalesce(array_to_string(list_sort(list(o_orderkey) FILTER (o_orderkey IS NOT NULL)), ','), '') order_ids FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def q363_collected(spark, d):
    o = ad.table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return ad.table(spark, d, C).join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.array_join(F.sort_array(F.collect_list("o_orderkey")), ",").alias("order_ids"))


@query("SELECT c_custkey, c_custkey * 10 + j id, c_mktsegment || j AS name FROM customer, range(0, 4) r(j) WHERE j < c_custkey % 5")
def q480_unnested(spark, d):
    k = F.col("c_custkey")
    items = F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda j: j < k % 5), lambda j: F.struct((k * 10 + j).alias("id"), F.concat("c_mktsegment", j.cast("string")).alias("name")))
    return ad.table(spark, d, C).select("c_custkey", F.inline(items))


@query("SELECT c_custkey, 'auth.' || c_mktsegment channel, 'rl:sign_in:' || c_custkey rate_key, contains(lower(c_mktsegment), 'build') OR contains(lower(c_mktsegment), 'auto') found FROM customer")
def q434_names(spark, d):
    k = F.col("c_custkey")
    return ad.table(spark, d, C).select("c_custkey", tx.dotted(F.lit("auth"), F.col("c_mktsegment")).alias("channel"), tx.rate_key(F.lit("sign_in"), k.cast("string")).alias("rate_key"), tx.contains_any(F.col("c_mktsegment"), ("build", "auto")).alias("found"))


@query("WITH l AS (SELECT c_custkey k, CASE WHEN c_custkey % 3 <> 0 THEN 'f' || c_custkey || ',,' || c_mktsegment || ',' END t FROM customer) SELECT k, CASE WHEN t IS NULL THEN 'new' ELSE 'f' || k || ',' || rtrim(split_part(t, ',,', 2), ',') || ',new' END grown, CASE WHEN t IS NULL THEN 0 ELSE 2 END n FROM l")
def q436_lists(spark, d):
    k = F.col("c_custkey")
    t = F.when(k % 3 != 0, F.concat(F.lit("f"), k.cast("string"), F.lit(",,"), "c_mktsegment", F.lit(",")))
    return ad.table(spark, d, C).select(k.alias("k"), tx.list_with(t, F.lit("new")).alias("grown"), F.size(tx.list_items(F.coalesce(t, F.lit("")))).alias("n"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 3 WHEN 'view' THEN 5 WHEN 'purchase' THEN 10 ELSE 13 END AS code FROM events")
def q440_status_codes(spark, d):
    e = F.col("event_type")
    kind = F.when(e == "click", "invalid_argument").when(e == "view", "not_found").when(e == "purchase", "aborted").otherwise("anything else")
    return ad.table(spark, d, "events").select("event_id", tx.status_code(kind).alias("code"))


@query("SELECT o_orderkey, greatest(0, (CAST(o_orderkey % 3 AS BIGINT) * 30 + o_orderkey % 40 - 20) * 86400000000 + o_orderkey % 1000) micros FROM orders")
def q454_intervals(spark, d):
    k = F.col("o_orderkey")
    return ad.table(spark, d, "orders").select("o_orderkey", tx.interval_micros(k % 3, k % 40 - 20, k % 1000).alias("micros"))


@query("SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN s_suppkey * 60 WHEN 1 THEN s_suppkey * 86400 WHEN 2 THEN s_suppkey * 3600 + 1800 WHEN 3 THEN NULL ELSE NULL END AS seconds, s_suppkey % 9 hits, 3600 * (1 + s_suppkey % 4) window_s FROM supplier")
def q457_durations(spark, d):
    k = F.col("s_suppkey")
    s = k.cast("string")
    raw = F.when(k % 5 == 0, F.concat(s, F.lit("m"))).when(k % 5 == 1, F.concat(s, F.lit("d"))).when(k % 5 == 2, F.concat(s, F.lit("h 30m"))).when(k % 5 == 3, F.concat(s, F.lit(" parsecs")))
    hits, window = tx.rate_limit(F.concat((k % 9).cast("string"), F.lit("/"), (1 + k % 4).cast("string"), F.lit("h")))
    return ad.table(spark, d, "supplier").select("s_suppkey", tx.duration_seconds(raw).alias("seconds"), hits.alias("hits"), window.alias("window_s"))


@query("SELECT k attempts_asked, greatest(k, 1) attempts, greatest(k, 1) - 1 retries, greatest(60, k * 7) most FROM range(-3, 40) t(k)")
def q456_retry_policies(spark, d):
    k = F.col("id")
    return spark.range(-3, 40).select(k.alias("attempts_asked"), *[c.alias(n) for n, c in q.retry_policy(k, F.lit(60), k * 7).items()])


@query("WITH x AS (SELECT o_orderkey, substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) || '-' || substr(md5(CAST(o_orderkey AS VARCHAR)), 9, 4) || '-4' || substr(md5(CAST(o_orderkey AS VARCHAR)), 14, 3) || '-' || substr(md5(CAST(o_orderkey AS VARCHAR)), 17, 4) || '-' || substr(md5(CAST(o_orderkey AS VARCHAR)), 21, 12) u FROM orders) SELECT o_orderkey, o_orderkey % 3 = 0 AS valid FROM x")
def q485_uuids(spark, d):
    h = F.md5(F.col("o_orderkey").cast("string").cast("binary"))
    u = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.substring(h, 17, 4), F.substring(h, 21, 12))
    k = F.col("o_orderkey") % 3
    shown = F.when(k == 0, u).when(k == 1, F.concat(F.lit("x"), F.substring(u, 2, 40), F.lit("-"))).otherwise(F.lit(None))
    return ad.table(spark, d, "orders").select("o_orderkey", tx.is_uuid(shown).alias("valid"))


NOW = 896_659_200  # 1998-06-01 00:00 UTC, a Monday


def weekly(spark, d):
    """Suppliers as schedules on a numbered weekday; some cannot be read."""
    k = F.col("s_suppkey")
    cron = F.when(k % 5 == 0, "at noon").otherwise(F.format_string("0 0 %d * * %d", (k % 24).cast("int"), (1 + k % 7).cast("int")))
    return ad.table(spark, d, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("name"), cron.alias("cron"), F.lit("UTC").alias("zone"), F.lit(True).alias("enabled"), F.lit("catch_up").alias("policy"), F.lit(NOW - 21 * 86400).cast("long").alias("last_at"))


@query(f"SELECT 's' || s_suppkey AS name, CAST({NOW} - 86400 * j + 3600 * (s_suppkey % 24) AS BIGINT) due_at FROM supplier, range(0, 23) r(j) WHERE s_suppkey % 5 <> 0 AND dayofweek(TIMESTAMP '1998-06-01' - to_days(CAST(j AS INT))) = s_suppkey % 7 AND {NOW} - 86400 * j + 3600 * (s_suppkey % 24) > {NOW} - 21 * 86400 AND {NOW} - 86400 * j + 3600 * (s_suppkey % 24) <= {NOW}")
def q450_numbered_weekdays(spark, d):
    return sd.due(weekly(spark, d), NOW)


@query("SELECT 's' || s_suppkey AS name FROM supplier WHERE s_suppkey % 5 = 0")
def q450_rejected_schedules(spark, d):
    return sd.rejected(weekly(spark, d)).select("name")


FAMILY = (
    "WITH RECURSIVE o AS (SELECT user_id family, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) r, event_type, event_id FROM events), c AS (SELECT family, r, CASE WHEN r = 1 THEN 'create' WHEN event_type = 'error' THEN 'revoke' ELSE 'rotate' END kind, CASE WHEN event_id % 11 = 0 THEN 0 ELSE r - 2 END AS token FROM o),"
    " f AS (SELECT family, r, 'created' outcome, CAST(0 AS BIGINT) cur, true alive FROM c WHERE r = 1 UNION ALL SELECT c.family, c.r,"
    " CASE WHEN c.token > f.cur THEN 'invalid' WHEN c.kind = 'revoke' THEN 'revoked' WHEN NOT f.alive THEN 'session revoked' WHEN c.token < f.cur THEN 'reuse detected' ELSE 'rotated' END,"
    " CASE WHEN c.token = f.cur AND c.kind = 'rotate' AND f.alive THEN f.cur + 1 ELSE f.cur END, CASE WHEN c.token > f.cur THEN f.alive WHEN c.kind = 'revoke' THEN false WHEN c.token < f.cur THEN false ELSE f.alive END FROM f JOIN c ON c.family = f.family AND c.r = f.r + 1)"
)


@query(FAMILY + " SELECT family, r seq, outcome FROM f")
def q507_family_outcomes(spark, d):
    return aq.QUERIES["q507_session_rotation"](spark, d)


@query(U + aq.IDS + " SELECT user_id, provider FROM ids WHERE user_id % 10 <> 1")
def q417_identities_left(spark, d):
    u = ad.users(spark, d)
    return ac.cascade_delete(u.where("id % 10 = 1").select("id"), u, aq.identities(spark, d))[1]


@query(Q + " SELECT id, channel FROM msgs WHERE channel <> 'orders.5-LOW'")
def q408_messages_left(spark, d):
    return q.clear(ad.messages(spark, d), ad.payloads(spark, d), ["orders.5-LOW"])[0].select("id", "channel")


TTL = 1_000_000
CALLS = f"""WITH RECURSIVE e AS (SELECT user_id u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) r, CAST(epoch(date_trunc('second', ts)) AS BIGINT) s, event_type, event_id FROM events),
c AS (SELECT u, r, s, CASE WHEN r % 6 = 1 THEN 'create' WHEN event_id % 10 = 3 THEN 'revoke_all' WHEN event_type = 'error' THEN 'revoke' ELSE 'rotate' END kind,
  u * 1000000 + (r - 1) // 6 - CASE WHEN event_id % 5 = 0 AND r > 6 AND r % 6 <> 1 THEN 1 ELSE 0 END fam, CASE WHEN event_id % 7 = 0 THEN 0 ELSE (r - 1) % 6 - 1 END tok FROM e),
p AS (SELECT *, last_value(CASE WHEN kind = 'create' THEN s END IGNORE NULLS) OVER (PARTITION BY u ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) made FROM c),
l AS (SELECT *, sum(CASE WHEN kind = 'create' AND (made IS NULL OR s - made >= {TTL}) THEN 1 ELSE 0 END) OVER (PARTITION BY u ORDER BY r) list FROM p),
z AS (SELECT a.fam, min_by(b.r, b.r) r, min_by(b.s, b.r) s FROM l a JOIN l b ON a.u = b.u AND a.list = b.list AND b.r > a.r AND a.kind = 'create' AND b.kind = 'revoke_all' AND b.s - b.made < {TTL} GROUP BY a.fam),
o AS (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY r) k FROM (SELECT fam, r, s, kind, tok FROM c WHERE kind <> 'revoke_all' UNION ALL SELECT fam, r, s, 'end', NULL FROM z)),
f AS (SELECT fam, k, r, 'created' outcome, true alive, [s] made FROM o WHERE k = 1
  UNION ALL SELECT fam, k, r, outcome, CASE WHEN outcome IN ('revoked', 'reuse detected') THEN false ELSE alive END, CASE WHEN outcome = 'rotated' THEN list_append(made, s) ELSE made END
  FROM (SELECT o.*, f.alive, f.made, CASE WHEN o.kind = 'end' THEN 'revoked' WHEN o.tok < 0 OR o.tok >= len(f.made) OR o.s >= f.made[CAST(o.tok AS INT) + 1] + {TTL} THEN 'invalid' WHEN o.kind = 'revoke' THEN 'revoked'
    WHEN NOT f.alive THEN 'session revoked' WHEN o.tok <> len(f.made) - 1 THEN 'reuse detected' ELSE 'rotated' END outcome FROM f JOIN o ON o.fam = f.fam AND o.k = f.k + 1))"""


@query(CALLS + " SELECT fam family, r seq, outcome FROM f")
def q507_expiry_and_revoke_all(spark, d):
    order = Window.partitionBy("user").orderBy("ts", "event_id")
    rows = ad.table(spark, d, "events").withColumnRenamed("user_id", "user").withColumn("seq", F.row_number().over(order).cast("long"))
    place, k = (F.col("seq") - 1) % 6, F.col("event_id")
    kind = F.when(place == 0, "create").when(k % 10 == 3, "revoke_all").when(F.col("event_type") == "error", "revoke").otherwise("rotate")
    late = F.when((k % 5 == 0) & (F.col("seq") > 6) & (place != 0), 1).otherwise(0)
    family = F.col("user") * 1_000_000 + F.floor((F.col("seq") - 1) / 6) - late
    token = F.when(k % 7 == 0, F.lit(0)).otherwise(place - 1).cast("long")
    return ac.sessions(rows.select("user", family.alias("family"), "seq", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("second"), kind.alias("kind"), token.alias("token")), TTL)


@query("WITH p AS (SELECT user_id host, event_id % 2 side, list(DISTINCT event_type) ports, min(event_type) FILTER (event_id % 3 = 0) device FROM events GROUP BY ALL), h AS (SELECT DISTINCT host FROM p) SELECT h.host, NOT (coalesce(list_sort(a.ports), []) = coalesce(list_sort(b.ports), [])) OR a.device IS DISTINCT FROM b.device changed FROM h LEFT JOIN p a ON a.host = h.host AND a.side = 0 LEFT JOIN p b ON b.host = h.host AND b.side = 1")
def q364_port_changes(spark, d):
    e = ad.table(spark, d, "events")
    state = e.groupBy(F.col("user_id").alias("host"), (F.col("event_id") % 2).alias("side")).agg(F.collect_set("event_type").alias("ports"), F.min(F.when(F.col("event_id") % 3 == 0, F.col("event_type"))).alias("device"))
    return ev.port_changes(state.where("side = 0"), state.where("side = 1"))


@query(f"SELECT 's' || s_suppkey AS name, least(10000, 1440 * (1 + s_suppkey % 20)) n, CAST({NOW} - 86400 * (1 + s_suppkey % 20) + 60 AS BIGINT) first_at, CAST({NOW} - 86400 * (1 + s_suppkey % 20) + 60 * least(10000, 1440 * (1 + s_suppkey % 20)) AS BIGINT) last_at FROM supplier")
def q356_capped_occurrences(spark, d):
    """Every minute over 1 to 20 days: the first 10,000 occurrences of each schedule."""
    k = F.col("s_suppkey")
    rows = ad.table(spark, d, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("name"), F.lit("* * * * *").alias("cron"), F.lit("UTC").alias("zone"), F.lit(True).alias("enabled"), F.lit("catch_up").alias("policy"), (F.lit(NOW) - 86400 * (1 + k % 20)).cast("long").alias("last_at"))
    return sd.due(rows, NOW).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("due_at").alias("first_at"), F.max("due_at").alias("last_at"))
