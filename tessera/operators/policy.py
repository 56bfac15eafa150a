"""Policy decisions: statements with actions, resources, principals and conditions against a table of requests.

Statements are tables, one row each: (sid, ord, effect, actions, not_actions, resources, not_resources, principals,
conditions), lists of patterns and array<struct<op, key, values>> of conditions; a null list is absent. They are joined
to requests (request, principal, action, resource, context: map<string, string>) by who they hold for: a user's own
policies, those of the user's groups, and the policies of the bucket that the resource names. So a request meets the
statements of its own principal and bucket through an equi-join, never all statements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.network import date_less, in_cidr, parse_arn
from ..functions.text import glob_match

STATEMENT = "sid string, ord int, effect string, actions array<string>, not_actions array<string>, resources array<string>, not_resources array<string>, principals array<string>, conditions array<struct<op: string, key: string, values: array<string>>>"


def action_matches(pattern: Column, action: Column) -> Column:
    """*, the same action in any case, or service:* (no other wildcards)."""
    p, a = F.lower(pattern), F.lower(action)
    return (pattern == "*") | (p == a) | (p.endswith(":*") & a.startswith(F.regexp_replace(p, r"\*$", "")))


def _listed(given: Column, inverse: Column, match) -> Column:
    """Any pattern of the list matches; or else there is an inverse list and none of it does."""
    hit = lambda c: F.coalesce(F.exists(c, match), F.lit(False))
    return hit(given) | ((F.size(F.coalesce(inverse, F.array().cast("array<string>"))) > 0) & ~hit(inverse))


def principal_matches(principals: Column, principal: Column) -> Column:
    """An absent list holds for everybody, one without a match for nobody; globs match names of users."""
    return principals.isNull() | (F.size(principals) == 0) | F.exists(principals, lambda p: (p == "*") | (p == principal) | (principal.startswith("arn:") & glob_match(p, principal)))


def compare(op: Column, actual: Column, expected: Column) -> Column:
    o = F.lower(op)
    plain = F.when(o.isin("stringequals", "stringlike", "stringnotequals"), glob_match(expected, actual)).when(o.isin("ipaddress", "notipaddress"), in_cidr(actual, expected))
    plain = plain.when(o.isin("datelessthan", "dategreaterthan"), date_less(actual, expected)).when(o == "bool", F.lower(actual) == F.lower(expected)).otherwise(actual == expected)
    return plain != o.isin("stringnotequals", "notipaddress", "dategreaterthan")  # each test stands once; these three want it false


def conditions_match(conditions: Column, context: Column) -> Column:
    """All conditions hold; of a condition's values any does; a key the context lacks (or has empty) fails."""

    def one(c: Column) -> Column:
        actual = F.try_element_at(context, F.when(F.lower(c.key).isin("aws:sourceip", "aws:currenttime"), F.lower(c.key)).otherwise(c.key))
        return F.coalesce((actual != "") & F.exists(c["values"], lambda v: compare(c.op, actual, v)), F.lit(False))

    return F.coalesce(F.forall(conditions, one), F.lit(True))


def statement_matches(action: Column, resource: Column, principal: Column, context: Column) -> Column:
    by_action = _listed(F.col("actions"), F.col("not_actions"), lambda p: action_matches(p, action))
    by_resource = _listed(F.col("resources"), F.col("not_resources"), lambda p: (p == "*") | glob_match(p, resource))
    return by_action & by_resource & principal_matches(F.col("principals"), principal) & conditions_match(F.col("conditions"), context)


def attached(users: DataFrame, groups: DataFrame, policies: DataFrame) -> DataFrame:
    """principal and the statements that hold for it: of its own policies, then of its groups'. A policy that doesn't exist
    is skipped, one that is reached twice counts once."""
    own = users.select(F.col("name").alias("principal"), F.explode("policies").alias("policy"))
    member = users.select(F.col("name").alias("principal"), F.explode("groups").alias("group"))
    theirs = member.join(groups.select(F.col("name").alias("group"), F.explode("policies").alias("policy")), "group")
    reached = own.unionByName(theirs.select("principal", "policy")).distinct()
    return reached.join(policies, "policy").drop("policy")


def candidates(requests: DataFrame, identity: DataFrame, by_bucket: DataFrame) -> DataFrame:
    """Requests with the statements of their principal (origin identity) and of their resource's bucket (origin resource)."""
    mine = requests.join(identity, "principal").withColumn("origin", F.lit("identity")).withColumn("principals", F.lit(None).cast("array<string>"))
    named = requests.withColumn("bucket", parse_arn(F.col("resource")).bucket)
    theirs = named.join(by_bucket, "bucket").drop("bucket").withColumn("origin", F.lit("resource"))
    return mine.unionByName(theirs)


def decide(requests: DataFrame, identity: DataFrame, by_bucket: DataFrame) -> DataFrame:
    """request, decision, matched_by: any denial first, then what the identity allows, then the resource, else ImplicitDeny.

    matched_by is the first statement (by ord, sid) that made the decision.
    """
    hits = candidates(requests, identity, by_bucket).where(statement_matches(F.col("action"), F.col("resource"), F.col("principal"), F.col("context")))
    rank = F.when(F.col("effect") == "Deny", 0).when(F.col("effect") == "Allow", F.when(F.col("origin") == "identity", 1).otherwise(2)).otherwise(3)
    best = hits.groupBy("request").agg(F.min(F.struct(rank.alias("rank"), "ord", "sid")).alias("m"))
    rows = requests.select("request").join(best, "request", "left")
    decision = F.when(F.col("m.rank") == 0, "ExplicitDeny").when(F.col("m.rank") < 3, "Allow").otherwise("ImplicitDeny")
    return rows.select("request", decision.alias("decision"), F.when(F.col("m.rank") < 3, F.col("m.sid")).alias("matched_by"))


def role_statements(credentials: DataFrame, roles: DataFrame, policies: DataFrame) -> DataFrame:
    """principal and statements of temporary credentials: those of the role's policies and the credential's inline ones,
    united (an inline policy adds, it doesn't limit)."""
    of_role = credentials.select("principal", "role").join(roles.select(F.col("name").alias("role"), F.explode("policies").alias("policy")), "role")
    inline = credentials.select("principal", F.explode(F.array_compact(F.array("inline"))).alias("policy"))
    return of_role.select("principal", "policy").unionByName(inline).distinct().join(policies, "policy").drop("policy")


#: Canned ACLs.
CANNED = ("private", "public-read", "public-read-write", "authenticated-read")


def acl_of(header: Column, grants: Column) -> Column:
    """The canned ACL of a request: of its grants (array of struct<grantee, permission>; null: none sent) what everybody
    may do, else the header's, else private."""
    has = lambda what: F.exists(grants, lambda g: (g.grantee == "AllUsers") & (g.permission == what))
    by_grants = F.when(has("READ") & has("WRITE"), "public-read-write").when(has("READ"), "public-read").otherwise("private")
    return F.when(grants.isNotNull(), by_grants).when(header.isin(*CANNED), header).otherwise("private")


def grants_of(acl: Column, owner: Column) -> Column:
    """The grants of a canned ACL, the owner's first."""
    grant = lambda who, what: F.struct(who.alias("grantee"), F.lit(what).alias("permission"))
    own, everybody, signed_in = grant(owner, "FULL_CONTROL"), F.lit("AllUsers"), F.lit("AuthenticatedUsers")
    return F.when(acl == "public-read", F.array(own, grant(everybody, "READ"))).when(acl == "public-read-write", F.array(own, grant(everybody, "READ"), grant(everybody, "WRITE"))).when(acl == "authenticated-read", F.array(own, grant(signed_in, "READ"))).otherwise(F.array(own))


def public_read(acl: Column) -> Column:
    return acl.isin("public-read", "public-read-write")


def token_outcome(issued_type: Column, expires: Column, revoked: Column, as_of: Column, wanted_type: Column) -> Column:
    """The first reason why a token isn't valid (expired, type, revoked), or valid; signatures are not this engine's."""
    return F.when(as_of > expires, "expired").when(issued_type != wanted_type, "type").when(revoked, "revoked").otherwise("valid")


def delegation_allows(operations: Column, operation: Column, expires: Column, as_of: Column) -> Column:
    return (F.array_contains(operations, "*") | F.array_contains(operations, operation)) & (as_of <= expires)


def access_policy(role: Column, permissions: Column, bucket_permissions: Column, bucket: Column, action: Column) -> Column:
    """Default deny. Administrators may do all; others what their permissions name (admin names all), or the bucket's list
    or the one for *, or a * in the bucket's list; listing takes a global read."""
    needed = F.when(action == "list", "read").otherwise(action)
    held = F.array_contains(permissions, needed) | F.array_contains(permissions, "admin")
    own, rest = F.try_element_at(bucket_permissions, bucket), F.try_element_at(bucket_permissions, F.lit("*"))
    there = F.coalesce(F.array_contains(own, needed) | F.array_contains(own, "*"), F.lit(False)) | F.coalesce(F.array_contains(rest, needed), F.lit(False))
    return (role == "admin") | (action.isin("read", "write", "delete", "list") & held) | (action.isin("read", "write", "delete") & there)


def vector_policy(role: Column, permissions: Column, bucket_readable: Column, bucket_writable: Column, bucket_deletable: Column, action: Column) -> Column:
    """Default deny for vector actions: administrators, the action itself or vector:*, or the plain right to the bucket's
    objects that the action needs (none is enough to manage)."""
    plain = F.when(action == "vector:Search", F.array_contains(permissions, "read") & bucket_readable).when(action == "vector:Index", F.array_contains(permissions, "write") & bucket_writable).when(action == "vector:Delete", F.array_contains(permissions, "delete") & bucket_deletable).otherwise(F.lit(False))
    return (role == "admin") | (action.startswith("vector:") & (F.array_contains(permissions, action) | F.array_contains(permissions, "vector:*") | F.array_contains(permissions, "admin") | plain))


def legacy_allowed(role: Column, permissions: Column, bucket_permissions: Column, bucket: Column, needed: Column) -> Column:
    """A bucket's own list (or the one for *) overrides the global permissions unless it is empty."""
    given = F.coalesce(F.try_element_at(bucket_permissions, bucket), F.try_element_at(bucket_permissions, F.lit("*")))
    everywhere = F.array_contains(permissions, needed) | F.array_contains(permissions, "admin")
    there = F.array_contains(given, needed) | F.array_contains(given, "*")
    return (role == "admin") | F.when(F.size(F.coalesce(given, F.array().cast("array<string>"))) > 0, there).otherwise(F.coalesce(everywhere, F.lit(False)))


#: Buckets by what they hold.
SENSITIVE, PUBLIC = ("secrets", "credentials", "private", "confidential"), ("public", "assets", "thumbnails")


def encryption_required(bucket: Column, marked: Column, size: Column) -> Column:
    """Sensitive buckets and marked objects always, then public buckets and objects of at most 1 KB never, others do."""
    return F.when(bucket.isin(*SENSITIVE) | marked, F.lit(True)).when(bucket.isin(*PUBLIC) | (size <= 1024), F.lit(False)).otherwise(F.lit(True))


#: What each administrative role may do.
FLAGS = ("view_status", "manage_buckets", "manage_users", "run_tiering", "manage_keys", "rebuild_index", "view_metrics", "view_logs")
CAPABILITIES = {"admin": FLAGS, "operator": ("view_status", "run_tiering", "rebuild_index", "view_metrics", "view_logs"), "viewer": ("view_status", "view_metrics")}


def capabilities(users: DataFrame, role: str = "role") -> DataFrame:
    """One boolean a capability; an unknown role has none."""
    return users.select("*", *[F.coalesce(F.col(role).isin(*[r for r, c in CAPABILITIES.items() if f in c]), F.lit(False)).alias(f) for f in FLAGS])


def _texts(raw: Column) -> Column:
    """A JSON string or array of strings as an array; null stays null."""
    return F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(raw.isNotNull(), F.array(raw))


def parse_policies(documents: DataFrame) -> DataFrame:
    """policy and its statements of JSON documents (policy, document); names of fields in either case and style.

    Principals other than users (services, federations) are kept as "service:..." and match no user. A document that
    is no JSON has no statements.
    """
    field = lambda m, name: F.get(F.filter(F.map_entries(m), lambda e: F.lower(F.replace(e.key, F.lit("_"), F.lit(""))) == name), F.lit(0))["value"]
    parsed = documents.select("policy", F.from_json(field(F.from_json("document", "map<string,string>"), "statement"), "array<map<string,string>>").alias("d"))
    rows = parsed.select("policy", F.posexplode("d").alias("pos", "s"))
    get = lambda name: field(F.col("s"), name)
    who = get("principal")
    named = F.from_json(who, "map<string,string>")
    users = F.coalesce(_texts(F.coalesce(F.try_element_at(named, F.lit("AWS")), F.try_element_at(named, F.lit("aws")))), F.array().cast("array<string>"))
    others = F.transform(F.filter(F.map_entries(named), lambda e: F.lower(e.key) != "aws"), lambda e: F.concat(F.lit("service:"), e.value))
    principals = F.when(who.startswith("{"), F.concat(users, others)).when(who.isNotNull(), _texts(who))
    conditions = F.flatten(F.transform(F.map_entries(F.from_json(get("condition"), "map<string,map<string,string>>")), lambda o: F.transform(F.map_entries(o.value), lambda c: F.struct(o.key.alias("op"), c.key.alias("key"), _texts(c.value).alias("values")))))
    return rows.select("policy", get("sid").alias("sid"), (F.col("pos") + 1).alias("ord"), get("effect").alias("effect"), _texts(get("action")).alias("actions"), _texts(get("notaction")).alias("not_actions"), _texts(get("resource")).alias("resources"), _texts(get("notresource")).alias("not_resources"), principals.alias("principals"), conditions.alias("conditions"))


#: Seconds that session and federation tokens last at most.
SESSION_CAP, FEDERATION_CAP = 129_600, 43_200


def role_duration(requested: Column, most: Column) -> Column:
    """Seconds of an assumed role: what was asked for if it is positive and at most the role's, else the role's."""
    return F.when((requested > 0) & (requested <= most), requested).otherwise(most)


def capped(requested: Column, most: int) -> Column:
    return F.least(requested, F.lit(most))


def origin_allowed(origin: Column, allowed: Column) -> Column:
    """Whether a list of origins has a * or the origin."""
    return F.array_contains(allowed, "*") | F.array_contains(allowed, origin)


def is_admin_action(action: Column) -> Column:
    return action.rlike("^(iam|sts|admin):")


def is_vector_action(action: Column) -> Column:
    return action.startswith("vector:")


#: Default requests a second and burst of each kind of call.
DEFAULT_LIMITS = {"PUT": (100, 20), "GET": (1000, 100), "DELETE": (500, 50), "LIST": (100, 20), "HEAD": (2000, 200), "CREATE_BUCKET": (10, 5)}


def limit_of(api: Column) -> Column:
    """struct(rate, burst) of a kind of call; null for an unknown one."""
    out = F.lit(None).cast("struct<rate: int, burst: int>")
    for name, (rate, burst) in DEFAULT_LIMITS.items():
        out = F.when(api == name, F.struct(F.lit(rate).alias("rate"), F.lit(burst).alias("burst"))).otherwise(out)
    return out
