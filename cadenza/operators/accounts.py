"""Accounts: handles, roles, tokens, optimistic updates, identities, rate limits and session families.

Rules that depend on the order of one key's events are folds over that key's rows, which stream through in order. Where a
key may hold a large share of all rows (rate limits), the fold runs over one compact row per second and key, so its cost
follows time, not traffic.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .folds import ordered_fold

ALNUM = r"^[\p{IsAlphabetic}\p{N}]+$"


@F.pandas_udf(StringType())
def fold_handle(handles: pd.Series) -> pd.Series:
    """Canonical composition, then lower case."""
    return handles.map(lambda h: unicodedata.normalize("NFC", h).lower(), na_action="ignore")


def valid_handle(handle: Column) -> Column:
    return F.length(handle).between(1, 15) & F.rlike(handle, F.lit(ALNUM))


def valid_password(password: Column) -> Column:
    return F.length(password) >= 12


def redact_bearer(text: Column) -> Column:
    """The token after each ``Bearer`` is replaced."""
    return F.regexp_replace(text, "(^| )Bearer( +)[^ ]+", "$1Bearer$2<redacted>")


def reapable(users: DataFrame, now: Column, grace_s: int) -> DataFrame:
    """Accounts that never took a handle and are older than the grace period."""
    return users.where(F.col("handle").isNull() & (F.col("created_at") < now - F.make_dt_interval(secs=F.lit(grace_s))))


def token_verdict(kid_known: Column, aud: Column, audience: Column, exp: Column, now: Column) -> Column:
    """First reason against a token, or ok; a missing key, expiry or audience counts as a wrong one."""
    known, alive, meant = (F.coalesce(c, F.lit(False)) for c in (kid_known, exp > now, aud == audience))
    return F.when(~known, "unknown key").when(~alive, "expired").when(~meant, "wrong audience").otherwise("ok")


def claims_verdict(kid_known: Column, aud: Column, audience: Column, exp: Column, now: Column, leeway_s: int = 60) -> Column:
    """As ``token_verdict`` for a list of audiences, of which one must be meant, and an expiry with some seconds of leeway."""
    return token_verdict(kid_known, F.array_contains(aud, audience), F.lit(True), exp + leeway_s, now)


def provider_verdict(issuer: Column, expected: Column, aud_matches: Column, exp: Column, now: Column) -> Column:
    """First reason against a sign-in provider's token, or ok: issuer, audience, expiry."""
    issued, meant, alive = (F.coalesce(c, F.lit(False)) for c in (issuer == expected, aud_matches, exp > now))
    return F.when(~issued, "issuer mismatch").when(~meant, "audience mismatch").when(~alive, "expired").otherwise("ok")


def allowed_audience(audience: Column, allowed: list[str]) -> Column:
    return F.coalesce(audience.isin(allowed), F.lit(False))


def authenticated(calls: DataFrame, tokens: DataFrame, strict: bool) -> DataFrame:
    """``calls`` (with token) and the user_id of their valid token (token, user_id, verdict).

    Strict: only calls with a valid token. Optional: all; those without a token, or with one that is not valid, have no user.
    """
    valid = tokens.where("verdict = 'ok'").select("token", "user_id").dropDuplicates(["token"])
    return calls.join(valid, "token", "inner" if strict else "left")


def optimistic_update(users: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(users after, outcomes) of ``updates`` (id, display_name, handle, handle_key, expected).

    Null fields stay as they are. An update applies where the version is the expected one and no other account has the
    handle's key. Of several updates of one id that would apply one does (the one with the least fields in their order), the
    others meet a conflict; of several accounts that ask for one free key the least id gets it. Outcomes: updated,
    conflict, not_found, already_exists.
    """
    own = updates.alias("n").join(users.alias("u"), F.col("n.id") == F.col("u.id"), "left")
    owner = users.where("handle_key is not null").groupBy("handle_key").agg(F.min("id").alias("owner"))
    own = own.join(owner.alias("o"), F.col("n.handle_key") == F.col("o.handle_key"), "left")
    taken = F.col("o.owner").isNotNull() & (F.col("o.owner") != F.col("n.id"))
    outcome = F.when(F.col("u.id").isNull(), "not_found").when(F.col("u.version") != F.col("n.expected"), "conflict").when(taken, "already_exists").otherwise("updated")
    rows = own.select(*[F.col(f"n.{c}").alias(c) for c in ("id", "display_name", "handle", "handle_key", "expected")], outcome.alias("outcome"))
    first = F.row_number().over(Window.partitionBy("id", "outcome").orderBy("handle_key", "display_name", "handle"))
    rows = rows.withColumn("outcome", F.when((F.col("outcome") == "updated") & (first > 1), "conflict").otherwise(F.col("outcome")))
    # accounts that keep their own key are not rivals; null keys are none
    rival = F.row_number().over(Window.partitionBy("handle_key", F.when(F.col("handle_key").isNull(), F.col("id")), "outcome").orderBy("id"))
    lost = (F.col("outcome") == "updated") & F.col("handle_key").isNotNull() & (rival > 1)
    rows = rows.withColumn("outcome", F.when(lost, "already_exists").otherwise(F.col("outcome")))
    fresh = rows.where("outcome = 'updated'").select("id", *[F.col(c).alias(f"_{c}") for c in ("display_name", "handle", "handle_key")], F.lit(1).alias("_one"))
    after = users.join(fresh, "id", "left")
    changed = {c: F.coalesce(f"_{c}", c) for c in ("display_name", "handle", "handle_key")}
    after = after.withColumns(changed | {"version": F.col("version") + F.coalesce("_one", F.lit(0))})
    return after.select(*users.columns), rows.select("id", "outcome")


def consume_tokens(credentials: DataFrame, attempts: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(credentials after, emails verified): a token counts once, before it expires; it is cleared and the email verified."""
    met = credentials.join(attempts.select("token").distinct(), "token", "left_semi").where(F.col("expires_at") > now).select("email")
    hit = credentials.join(met.withColumn("_hit", F.lit(True)), "email", "left")
    after = hit.withColumns({"verified": F.col("verified") | F.coalesce("_hit", F.lit(False)), "token": F.when(F.col("_hit").isNull(), F.col("token")), "expires_at": F.when(F.col("_hit").isNull(), F.col("expires_at"))})
    return after.select(*credentials.columns), met


def reset_passwords(credentials: DataFrame, attempts: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(credentials after, emails reset) of ``attempts`` (reset_token, new_hash): a token counts once, before it expires.

    Of several attempts with one token the least hash counts.
    """
    asked = attempts.groupBy("reset_token").agg(F.min("new_hash").alias("_hash"))
    rows = credentials.join(asked, "reset_token", "left")
    hit = F.col("_hash").isNotNull() & F.coalesce(F.col("reset_expires_at") > now, F.lit(False))
    changed = {"password_hash": F.when(hit, F.col("_hash")).otherwise(F.col("password_hash")), "reset_token": F.when(~hit, F.col("reset_token")), "reset_expires_at": F.when(~hit, F.col("reset_expires_at"))}
    after = rows.withColumn("_hit", hit)
    return after.select("_hit", *[changed[c].alias(c) if c in changed else F.col(c) for c in credentials.columns]).drop("_hit"), after.where("_hit").select("email")


def new_accounts(asks: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(users, identities, roles) of accounts for ``asks`` (id, provider, subject): version 1, no handle, the global role user."""
    users = asks.select("id", F.lit(None).cast("string").alias("handle"), F.lit(1).cast("long").alias("version"), now.alias("created_at"))
    identities = asks.select(F.col("id").alias("user_id"), "provider", "subject", now.alias("linked_at"))
    return users, identities, asks.select(F.col("id").alias("user_id"), F.lit("global").alias("scope"), F.lit("user").alias("role"))


def resolve_or_provision(identities: DataFrame, asks: DataFrame) -> DataFrame:
    """(provider, subject, user_id, created) of ``asks`` (id, provider, subject): the owner, or a new account of the ask's id.

    Asks that repeat a provider and subject are one account, the least id.
    """
    once = asks.groupBy("provider", "subject").agg(F.min("id").alias("id"))
    owned = identities.select("provider", "subject", "user_id").dropDuplicates(["provider", "subject"])
    rows = once.join(owned, ["provider", "subject"], "left")
    return rows.select("provider", "subject", F.coalesce("user_id", "id").alias("user_id"), F.col("user_id").isNull().alias("created"))


def link(identities: DataFrame, asks: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(identities after, outcomes) of ``asks`` (user_id, provider, subject): linked, unchanged or already_exists.

    Of several accounts that ask for one free identity the least id gets it.
    """
    owned = identities.select("provider", "subject", F.col("user_id").alias("_owner")).dropDuplicates(["provider", "subject"])
    rows = asks.dropDuplicates(["user_id", "provider", "subject"]).join(owned, ["provider", "subject"], "left")
    first = F.min("user_id").over(Window.partitionBy("provider", "subject"))
    owner = F.coalesce(F.col("_owner"), first)
    outcome = F.when(owner != F.col("user_id"), "already_exists").when(F.col("_owner").isNotNull(), "unchanged").otherwise("linked")
    rows = rows.withColumn("outcome", outcome)
    fresh = rows.where("outcome = 'linked'").select("user_id", "provider", "subject", now.alias("linked_at"))
    return identities.unionByName(fresh.select(*identities.columns)), rows.select("user_id", "provider", "subject", "outcome")


def effective_roles(roles: DataFrame, scopes: list[str]) -> DataFrame:
    """(user_id, roles): those of the given scopes, repeats kept, sorted."""
    return roles.where(F.col("scope").isin(scopes)).groupBy("user_id").agg(F.sort_array(F.collect_list("role")).alias("roles"))


def unlink(identities: DataFrame, asks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(identities after, outcomes) of ``asks`` (user_id, provider), one per user: an account's last identity stays."""
    held = identities.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    known = asks.join(identities.select("user_id", "provider").distinct().withColumn("_has", F.lit(True)), ["user_id", "provider"], "left").join(held, "user_id", "left")
    outcome = F.when(F.col("_has").isNull(), "not_found").when(F.col("n") <= 1, "last_identity").otherwise("unlinked")
    outcomes = known.select("user_id", "provider", outcome.alias("outcome"))
    return identities.join(outcomes.where("outcome = 'unlinked'"), ["user_id", "provider"], "left_anti"), outcomes


def insert_new(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``table`` and the first of ``rows`` for each key that it lacks (insert, on conflict do nothing)."""
    return table.unionByName(rows.dropDuplicates(key).join(table, key, "left_anti").select(*table.columns))


def cascade_delete(ids: DataFrame, users: DataFrame, *children: DataFrame) -> list[DataFrame]:
    """The tables without the accounts ``ids`` (id) and what hangs on them (user_id)."""
    return [users.join(ids, "id", "left_anti"), *[c.join(ids.select(F.col("id").alias("user_id")), "user_id", "left_anti") for c in children]]


def ttl_windows(hits: DataFrame, ttl_s: int) -> DataFrame:
    """(key, second, n, window_start, before): hits per key and second, with the start of the counter they fall into.

    A counter starts with the first hit after the one before has expired and lives ``ttl_s`` seconds from there; hits do
    not prolong it. ``before`` counts the hits of the counter in earlier seconds. Seconds are first summed per key, and a
    key's seconds are folded in order with a state of two numbers.
    """
    seconds = hits.groupBy("key", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("second")).agg(F.count(F.lit(1)).alias("n"))

    def step(state: list, second: int, n: int) -> tuple:
        if state[0] is None or second >= state[0] + ttl_s:
            state[:] = second, 0
        before = state[1]
        state[1] += n
        return n, state[0], before

    return ordered_fold(seconds, "key", "second", ["n"], lambda: [None, 0], step, "n long, window_start long, before long")


def rate_limited(hits: DataFrame, most: int, ttl_s: int) -> DataFrame:
    """(key, second, n, allowed): how many of each second's hits stay within the limit of their counter."""
    w = ttl_windows(hits, ttl_s)
    allowed = F.least(F.col("n"), F.greatest(F.lit(0), F.lit(most) - F.col("before")))
    return w.select("key", "second", "n", allowed.cast("long").alias("allowed"))


def lockouts(attempts: DataFrame, most: int, ttl_s: int) -> DataFrame:
    """(key, seq, outcome) of sign-in attempts (key, seq, second, success), in order of seq.

    A key with ``most`` failures in its counter is locked; only failures count; success clears the counter.
    """

    def step(state: list, seq: int, second: int, success: bool) -> tuple:
        until, fails = state
        if second >= until:
            fails = 0
        if fails >= most:
            outcome = "locked"
        elif success:
            outcome, until, fails = "ok", 0, 0
        else:
            outcome, until, fails = "failed", until if fails else second + ttl_s, fails + 1
        state[:] = until, fails
        return (outcome,)

    return ordered_fold(attempts, "key", "seq", ["second", "success"], lambda: [0, 0], step, "outcome string")


def rotations(calls: DataFrame) -> DataFrame:
    """(family, seq, outcome) of calls (family, seq, kind, token) on refresh-token families, in order of seq.

    kind: create (token becomes current), rotate (a token that was current before: the current one moves on by one, an
    earlier one is reuse and revokes the family), revoke. Tokens are numbered from 0 within a family.
    """

    def step(state: list, seq: int, kind: str, token: int) -> tuple:
        current, alive = state
        if kind == "create":
            state[:] = 0, True
            return ("created",)
        if current < 0 or token > current:
            return ("invalid",)
        if kind == "revoke":
            state[1] = False
            return ("revoked",)
        if not alive:
            return ("session revoked",)
        if token < current:
            state[1] = False
            return ("reuse detected",)
        state[0] += 1
        return ("rotated",)

    return ordered_fold(calls, "family", "seq", ["kind", "token"], lambda: [-1, False], step, "outcome string")


def sessions(calls: DataFrame, ttl_s: int) -> DataFrame:
    """(family, seq, outcome) of calls (user, family, seq, second, kind, token) when everything stored lives ``ttl_s`` seconds.

    kind: create, rotate and revoke as in ``rotations``, and revoke_all (no family), which ends the families that the
    user's list names and has a row for each of them. A token lives from its issue, a family from its last rotation. The
    list lives from the user's last create; a create after its end starts a new list, so families of the old one are out
    of reach of revoke_all. seq numbers a user's calls. Only the first revoke_all that reaches a family matters, so it
    becomes one more call of the family and each family is folded by itself.
    """
    order = Window.partitionBy("user").orderBy("seq")
    created = F.last(F.when(F.col("kind") == "create", F.col("second")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    listed = F.coalesce(F.col("second") - created < ttl_s, F.lit(False))
    fresh = (F.col("kind") == "create") & ~listed
    rows = calls.withColumn("_listed", listed).withColumn("_list", F.sum(fresh.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = F.when((F.col("kind") == "revoke_all") & F.col("_listed"), F.struct("seq", "second"))
    later = Window.partitionBy("user", "_list").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("_end", F.min(ends).over(later))
    own = rows.where("kind <> 'revoke_all'").select("family", "seq", "second", "kind", "token")
    ended = rows.where("kind = 'create' and _end is not null").select("family", "_end.seq", "_end.second", F.lit("end").alias("kind"), F.lit(None).cast("long").alias("token"))

    def step(state: list, seq: int, second: int, kind: str, token: int | None) -> tuple:
        current, alive, issued = state
        if kind == "create":
            state[:] = 0, True, {0: second}
            return ("created",)
        if kind == "end":
            state[1] = False
            return ("revoked",)
        for old in [k for k, t in issued.items() if second >= t + ttl_s]:
            del issued[old]
        if token not in issued:
            return ("invalid",)
        if kind == "revoke":
            state[1] = False
            return ("revoked",)
        if not alive:
            return ("session revoked",)
        if token != current:
            state[1] = False
            return ("reuse detected",)
        state[0] += 1
        issued[current + 1] = second
        return ("rotated",)

    return ordered_fold(own.unionByName(ended), "family", "seq", ["second", "kind", "token"], lambda: [-1, False, {}], step, "outcome string")


def keyed_values(calls: DataFrame) -> DataFrame:
    """(key, seq, found): what each call finds in a store of values with lifetimes, folded in order of seq.

    ``calls`` has (key, seq, second, op, value, ttl_s). ``set`` stores the value for its lifetime, ``get`` finds it until then,
    ``del`` removes it, ``incr`` adds one and finds the sum: a counter that is not there starts at 1 and lives from its first
    increment, which later ones do not prolong. ``set`` and ``del`` find nothing.
    """

    def step(state: list, seq: int, second: int, op: str, value: str | None, ttl: int | None) -> tuple:
        if state and second >= state[1]:
            state.clear()
        if op == "set":
            state[:] = value, second + ttl
        elif op == "del":
            state.clear()
        elif op == "incr":
            state[:] = (str(int(state[0]) + 1), state[1]) if state else ("1", second + ttl)
        return (state[0] if state and op in ("get", "incr") else None,)

    return ordered_fold(calls, "key", "seq", ["second", "op", "value", "ttl_s"], list, step, "found string")


def credentials_by_email(asked: DataFrame, credentials: DataFrame) -> DataFrame:
    """``asked`` (with email) and the password_hash and email_verified of its credential, null where there is none."""
    return asked.join(credentials.select("email", "password_hash", "email_verified"), "email", "left")
