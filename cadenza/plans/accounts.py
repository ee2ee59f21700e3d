"""Queries over accounts, limits and sessions, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import accounts as ac
from . import adapters as ad
from .registry import registry

QUERIES, SQL, query = registry()
U = ad.USERS_SQL
AT = "TIMESTAMP '1998-06-01 00:00:00'"


def now():
    return F.lit("1998-06-01 00:00:00").cast("timestamp_ntz")


@query(U + f" SELECT id, created_at FROM users WHERE handle IS NULL AND created_at < {AT} - INTERVAL 30 DAY")
def q215_orphans(spark, d):
    return ac.reapable(ad.users(spark, d), now(), 30 * 86400).select("id", "created_at")


@query("SELECT doc_id, lower(nfc_normalize(lang || '.É' || source)) handle_key, length(source) BETWEEN 1 AND 15 AND regexp_full_match(source, '[a-zA-Z0-9]+') valid, length(source || lang) >= 12 strong FROM documents")
def q430_handles(spark, d):
    docs = ad.table(spark, d, "documents")
    return docs.select("doc_id", ac.fold_handle(F.concat("lang", F.lit(".É"), "source")).alias("handle_key"), ac.valid_handle(F.col("source")).alias("valid"), ac.valid_password(F.concat("source", "lang")).alias("strong"))


@query("SELECT conv_id, turn, regexp_replace('auth: Bearer ' || text || ' Bearer  x', '(^| )Bearer( +)[^ ]+', '\\1Bearer\\2<redacted>', 'g') line FROM conversations")
def q433_redacted(spark, d):
    line = F.concat(F.lit("auth: Bearer "), "text", F.lit(" Bearer  x"))
    return ad.table(spark, d, "conversations").select("conv_id", "turn", ac.redact_bearer(line).alias("line"))


@query(U + ", cl AS (SELECT id, CASE id % 3 WHEN 0 THEN 'music' ELSE 'live' END aud, 896659200 + (id % 9 - 4) * 60 exp, id % 7 <> 0 kid FROM users) SELECT id, CASE WHEN NOT kid THEN 'unknown key' WHEN exp <= 896659200 THEN 'expired' WHEN aud <> 'music' THEN 'wrong audience' ELSE 'ok' END verdict FROM cl")
def q217_token_checks(spark, d):
    k = F.col("id")
    aud = F.when(k % 3 == 0, "music").otherwise("live")
    return ad.users(spark, d).select("id", ac.token_verdict(k % 7 != 0, aud, F.lit("music"), 896659200 + (k % 9 - 4) * 60, F.lit(896659200)).alias("verdict"))


ROLES = ", roles AS (SELECT c_custkey user_id, scope, CASE WHEN (c_custkey + length(scope)) % 2 = 0 THEN 'admin' ELSE 'user' END role FROM customer, (VALUES ('global'), ('music'), ('live')) s(scope) WHERE c_custkey % length(scope) <> 1)"


def roles(spark, d):
    scope = F.explode(F.array(*map(F.lit, ("global", "music", "live"))))
    rows = ad.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), scope.alias("scope"))
    role = F.when((F.col("user_id") + F.length("scope")) % 2 == 0, "admin").otherwise("user")
    return rows.where(F.col("user_id") % F.length("scope") != 1).select("user_id", "scope", role.alias("role"))


@query(U + ROLES + " SELECT user_id, array_to_string(list(role ORDER BY role), ',') roles FROM roles WHERE scope IN ('global', 'music') GROUP BY user_id")
def q362_effective_roles(spark, d):
    return ac.effective_roles(roles(spark, d), ["global", "music"]).select("user_id", F.array_join("roles", ",").alias("roles"))


@query(U + ROLES + " SELECT id, coalesce(bool_or(role = 'admin'), false) allowed FROM users LEFT JOIN roles ON user_id = id AND scope = 'global' GROUP BY id")
def q216_admin_guard(spark, d):
    own = roles(spark, d).where("scope = 'global'").groupBy(F.col("user_id").alias("id")).agg(F.bool_or(F.col("role") == "admin").alias("a"))
    return ad.users(spark, d).join(own, "id", "left").select("id", F.coalesce("a", F.lit(False)).alias("allowed"))


UPD = ", up AS (SELECT c_custkey + CASE WHEN c_custkey % 17 = 0 THEN 100000000 ELSE 0 END id, CASE WHEN c_custkey % 2 = 0 THEN 'New ' || c_custkey END display_name, CASE WHEN c_custkey % 6 = 0 THEN 'cust' || (c_custkey + 1) END handle_key, 1 + c_custkey % 4 expected FROM customer), ow AS (SELECT handle_key, min(id) AS owner FROM users WHERE handle_key IS NOT NULL GROUP BY 1), oc AS (SELECT p.*, u.id uid, CASE WHEN u.id IS NULL THEN 'not_found' WHEN u.version <> p.expected THEN 'conflict' WHEN o.owner IS NOT NULL AND o.owner <> p.id THEN 'already_exists' ELSE 'updated' END outcome FROM up p LEFT JOIN users u ON u.id = p.id LEFT JOIN ow o ON o.handle_key = p.handle_key)"


def account_updates(spark, d):
    k = F.col("c_custkey")
    handle = F.when(k % 6 == 0, F.concat(F.lit("cust"), (k + 1).cast("string")))
    return ad.table(spark, d, "customer").select(
        (k + F.when(k % 17 == 0, 100_000_000).otherwise(0)).alias("id"), F.when(k % 2 == 0, F.concat(F.lit("New "), k.cast("string"))).alias("display_name"), handle.alias("handle"), handle.alias("handle_key"), (1 + k % 4).alias("expected")
    )


@query(U + UPD + " SELECT id, outcome FROM oc")
def q413_update_outcomes(spark, d):
    return ac.optimistic_update(ad.users(spark, d), account_updates(spark, d))[1]


@query(U + UPD + " SELECT u.id, coalesce(o.display_name, u.display_name) display_name, coalesce(o.handle_key, u.handle_key) handle_key, u.version + CASE WHEN o.id IS NULL THEN 0 ELSE 1 END AS version FROM users u LEFT JOIN (SELECT * FROM oc WHERE outcome = 'updated') o ON o.id = u.id")
def q418_updated_users(spark, d):
    return ac.optimistic_update(ad.users(spark, d), account_updates(spark, d))[0].select("id", "display_name", "handle_key", "version")


CRED = ", cr AS (SELECT c_custkey email, CASE WHEN c_custkey % 4 <> 0 THEN 't' || c_custkey END AS token, 1000 + c_custkey % 20 expires_at, c_custkey % 9 = 0 verified FROM customer), hit AS (SELECT email FROM cr WHERE expires_at > 1010 AND token IN (SELECT 't' || c_custkey FROM customer WHERE c_custkey % 3 = 0))"


def credentials(spark, d):
    k = F.col("c_custkey")
    return ad.table(spark, d, "customer").select(k.alias("email"), F.when(k % 4 != 0, F.concat(F.lit("t"), k.cast("string"))).alias("token"), (1000 + k % 20).alias("expires_at"), (k % 9 == 0).alias("verified"))


@query(U + CRED + " SELECT email, verified OR email IN (SELECT email FROM hit) verified, CASE WHEN email NOT IN (SELECT email FROM hit) THEN token END AS token FROM cr")
def q414_consumed_tokens(spark, d):
    asks = ad.table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("token"))
    return ac.consume_tokens(credentials(spark, d), asks, F.lit(1010))[0].select("email", "verified", "token")


IDS = ", ids AS (SELECT c_custkey user_id, provider, row_number() OVER (PARTITION BY c_custkey ORDER BY provider) seq FROM customer, (VALUES ('apple'), ('google'), ('local')) p(provider) WHERE (c_custkey + length(provider)) % 3 <> 0), asks AS (SELECT c_custkey user_id, CASE WHEN c_custkey % 2 = 0 THEN 'google' ELSE 'apple' END provider FROM customer)"


def identities(spark, d):
    provider = F.explode(F.array(*map(F.lit, ("apple", "google", "local"))))
    rows = ad.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), provider.alias("provider"))
    return rows.where((F.col("user_id") + F.length("provider")) % 3 != 0)


def unlink_asks(spark, d):
    k = F.col("c_custkey")
    return ad.table(spark, d, "customer").select(k.alias("user_id"), F.when(k % 2 == 0, "google").otherwise("apple").alias("provider"))


@query(U + IDS + " SELECT a.user_id, a.provider, CASE WHEN i.user_id IS NULL THEN 'not_found' WHEN n <= 1 THEN 'last_identity' ELSE 'unlinked' END outcome FROM asks a LEFT JOIN ids i ON i.user_id = a.user_id AND i.provider = a.provider LEFT JOIN (SELECT user_id, count(*) n FROM ids GROUP BY 1) c ON c.user_id = a.user_id")
def q416_unlink_outcomes(spark, d):
    return ac.unlink(identities(spark, d), unlink_asks(spark, d))[1]


@query(U + IDS + " SELECT user_id, array_to_string(list(provider ORDER BY seq), ',') providers, count(*) n FROM ids GROUP BY user_id")
def q351_identities_in_order(spark, d):
    return identities(spark, d).groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list("provider")), ",").alias("providers"), F.count(F.lit(1)).alias("n"))


@query(U + IDS + " SELECT (SELECT count(*) FROM users WHERE id % 10 <> 1) users, (SELECT count(*) FROM ids WHERE user_id % 10 <> 1) identities")
def q417_cascade_delete(spark, d):
    u = ad.users(spark, d)
    users, ids = ac.cascade_delete(u.where("id % 10 = 1").select("id"), u, identities(spark, d))
    return users.agg(F.count(F.lit(1)).alias("users")).join(ids.agg(F.count(F.lit(1)).alias("identities")))


@query(U + " SELECT handle_key, id FROM (SELECT handle_key, min(id) id FROM users WHERE id % 2 = 0 AND handle_key IS NOT NULL GROUP BY 1) UNION ALL SELECT handle_key, min(id) FROM users WHERE id % 2 <> 0 AND handle_key IS NOT NULL AND handle_key NOT IN (SELECT handle_key FROM users WHERE id % 2 = 0 AND handle_key IS NOT NULL) GROUP BY 1")
def q412_insert_new(spark, d):
    named = ad.users(spark, d).where("handle_key is not null").groupBy("handle_key", (F.col("id") % 2).alias("part")).agg(F.min("id").alias("id"))
    return ac.insert_new(named.where("part = 0").drop("part"), named.where("part <> 0").drop("part"), ["handle_key"])


@query("SELECT k AS \"key\", second, n, CAST(least(n, greatest(0, 3 - before)) AS BIGINT) allowed FROM (WITH RECURSIVE s AS (SELECT user_id k, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS second, count(*) n FROM events GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY second) r FROM s), f AS (SELECT k, second, n, r, second st, CAST(0 AS BIGINT) before FROM o WHERE r = 1 UNION ALL SELECT o.k, o.second, o.n, o.r, CASE WHEN o.second >= f.st + 86400 THEN o.second ELSE f.st END, CAST(CASE WHEN o.second >= f.st + 86400 THEN 0 ELSE f.before + f.n END AS BIGINT) FROM f JOIN o ON o.k = f.k AND o.r = f.r + 1) SELECT * FROM f)")
def q505_rate_limit(spark, d):
    hits = ad.table(spark, d, "events").select(F.col("user_id").alias("key"), "ts")
    return ac.rate_limited(hits, 3, 86400)


def sign_ins(spark, d):
    e = ad.table(spark, d, "events")
    return e.select(F.col("user_id").alias("key"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("seq"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("second"), (F.col("event_type") == "purchase").alias("success"))


@query(
    "WITH RECURSIVE o AS (SELECT user_id k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) r, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS second, event_type = 'purchase' ok FROM events), f AS (SELECT k, r, CASE WHEN ok THEN 'ok' ELSE 'failed' END outcome, CASE WHEN ok THEN 0 ELSE 1 END fails, CASE WHEN ok THEN 0 ELSE second + 864000 END until FROM o WHERE r = 1"
    " UNION ALL SELECT o.k, o.r, CASE WHEN c >= 3 THEN 'locked' WHEN o.ok THEN 'ok' ELSE 'failed' END, CASE WHEN c >= 3 THEN c WHEN o.ok THEN 0 ELSE c + 1 END, CASE WHEN c >= 3 THEN until WHEN o.ok THEN 0 WHEN c = 0 THEN o.second + 864000 ELSE until END FROM (SELECT o.*, f.until, CASE WHEN o.second >= f.until THEN 0 ELSE f.fails END c FROM f JOIN o ON o.k = f.k AND o.r = f.r + 1) o) SELECT k AS \"key\", r seq, outcome FROM f"
)
def q506_lockout(spark, d):
    return ac.lockouts(sign_ins(spark, d), 3, 864000)


@query()
def q507_session_rotation(spark, d):
    e = ad.table(spark, d, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    kind = F.when(F.col("seq") == 1, "create").when(F.col("event_type") == "error", "revoke").otherwise("rotate")
    rows = e.select(F.col("user_id").alias("family"), seq.alias("seq"), "event_type", "event_id")
    return ac.rotations(rows.select("family", "seq", kind.alias("kind"), F.when(F.col("event_id") % 11 == 0, 0).otherwise(F.col("seq") - 2).cast("long").alias("token")))
