"""Queries of policies, permissions and identities over the driver's tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import network
from ..operators import policy, tables
from ..sources.tables import AS_OF, objects, table
from .registry import query

_USER = "arn:aws:iam:::user/"
#: The documents that the queries evaluate.
DOCUMENTS = {
    "p1": {"Statement": [{"Sid": "s1", "Effect": "Allow", "Action": ["s3:view", "s3:CLICK"], "Resource": "arn:aws:s3:::src1*/k/*"}]},
    "p2": {"statement": [{"sid": "s2", "effect": "Allow", "action": "s3:*", "resource": ["*"], "condition": {"IpAddress": {"aws:SourceIp": ["10.1.0.0/28", "10.2.0.0/16"]}}}]},
    "p3": {"Statement": [{"Sid": "s3", "Effect": "Deny", "NotAction": "s3:view", "Resource": "arn:aws:s3:::src?/k/1?"}]},
    "p4": {"Statement": [{"Sid": "s4", "Effect": "Allow", "Action": "*", "NotResource": "arn:aws:s3:::src5/*", "Condition": {"StringLike": {"team": "a*"}, "DateLessThan": {"aws:CurrentTime": "2024-01-15T00:00:00Z"}}}]},
    "p5": {"Statement": [{"Sid": "s5", "Effect": "Deny", "Action": "S3:ERROR", "Resource": "*", "Condition": {"Bool": {"mfa": "true"}}}]},
}
BUCKET_DOCUMENTS = {
    "src1": {"Statement": [{"Sid": "b1", "Effect": "Allow", "Principal": "*", "Action": "s3:view", "Resource": "arn:aws:s3:::src1/*"}]},
    "src2": {"Statement": [{"Sid": "b2", "Effect": "Deny", "Principal": {"AWS": [f"{_USER}u1?"]}, "Action": "*", "Resource": "*"}]},
    "src3": {"Statement": [{"Sid": "b3", "Effect": "Allow", "Principal": {"Service": "logs"}, "Action": "*", "Resource": "*"}]},
    "src4": {"Statement": [{"Sid": "b4", "Effect": "Allow", "Principal": "*", "Action": "s3:click", "Resource": "arn:aws:s3:::src4/k.7*"}]},
}


def documents(spark: SparkSession, made: dict[str, dict]) -> DataFrame:
    return policy.parse_policies(spark.createDataFrame([(k, json.dumps(v)) for k, v in made.items()], "policy string, document string"))


def users(spark: SparkSession, d: str) -> DataFrame:
    """Customers as users: a group of their nation, policies by number (one of them doesn't exist), two access keys."""
    c, n = table(spark, d, "customer"), F.col("c_custkey")
    own = F.when(n % 4 == 0, F.array(F.lit("p1"))).when(n % 4 == 1, F.array(F.lit("p2"), F.lit("missing"))).otherwise(F.array().cast("array<string>"))
    key = lambda s, active: F.struct(F.concat(F.lit(f"AK{s}"), n).alias("id"), F.when(active, "Active").otherwise("Inactive").alias("status"))
    return c.select(F.concat(F.lit(f"{_USER}u"), n).alias("name"), F.array(F.concat(F.lit("g"), "c_nationkey")).alias("groups"), own.alias("policies"), F.array(key("A", n % 2 == 0), key("B", n % 3 == 0)).alias("access_keys"))


def groups(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), F.col("n_regionkey")
    held = F.when(r == 0, F.array(F.lit("p3"))).when(r == 1, F.array(F.lit("p4"), F.lit("p1"))).when(r == 2, F.array(F.lit("p5"))).otherwise(F.array().cast("array<string>"))
    return n.select(F.concat(F.lit("g"), "n_nationkey").alias("name"), held.alias("policies"))


def requests(spark: SparkSession, d: str) -> DataFrame:
    e, u = table(spark, d, "events"), F.col("user_id")
    context = F.create_map(F.lit("aws:sourceip"), F.concat(F.lit("10."), u % 3, F.lit(".0."), u % 50), F.lit("aws:currenttime"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("team"), F.when(u % 2 == 0, "alpha").otherwise("beta"))
    return e.select(F.col("event_id").alias("request"), F.concat(F.lit(f"{_USER}u"), u + 1).alias("principal"), F.concat(F.lit("s3:"), "event_type").alias("action"), F.concat(F.lit("arn:aws:s3:::src"), u % 20, F.lit("/k/"), F.get_json_object("props", "$.k")).alias("resource"), context.alias("context"))


def _buckets(spark: SparkSession) -> DataFrame:
    return documents(spark, BUCKET_DOCUMENTS).withColumnRenamed("policy", "bucket").withColumn("ord", F.col("ord") + 10)


#: The decisions by hand: each statement as a plain condition on the tables' columns.
_DECIDED = """r AS (SELECT event_id AS request, user_id, user_id % 20 AS b, event_type AS t, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, ts, c_custkey AS c, n_regionkey AS g FROM events LEFT JOIN customer ON c_custkey = user_id + 1 LEFT JOIN nation ON c_nationkey = n_nationkey),
s AS (SELECT request,
 coalesce(g = 0 AND t <> 'view' AND b < 10 AND k BETWEEN 10 AND 19, false) AS s3, b = 2 AND user_id + 1 BETWEEN 10 AND 19 AS b2,
 coalesce((c % 4 = 0 OR g = 1) AND t IN ('view', 'click') AND (b = 1 OR b >= 10), false) AS s1,
 coalesce(c % 4 = 1 AND (user_id % 3 = 2 OR (user_id % 3 = 1 AND user_id % 50 < 16)), false) AS s2,
 coalesce(g = 1 AND b <> 5 AND user_id % 2 = 0 AND ts < TIMESTAMP '2024-01-15 00:00:00', false) AS s4, b = 1 AND t = 'view' AS b1 FROM r)"""


@query("iam_decisions", f"WITH {_DECIDED} SELECT request, CASE WHEN s3 OR b2 THEN 'ExplicitDeny' WHEN s1 OR s2 OR s4 OR b1 THEN 'Allow' ELSE 'ImplicitDeny' END AS decision, CASE WHEN s3 THEN 's3' WHEN b2 THEN 'b2' WHEN s1 THEN 's1' WHEN s2 THEN 's2' WHEN s4 THEN 's4' WHEN b1 THEN 'b1' ELSE '' END AS matched_by FROM s")
def _decisions(spark, d):
    made = documents(spark, DOCUMENTS)
    held = policy.attached(users(spark, d), groups(spark, d), made)
    # statements keep the order of their names, whatever document they stand in
    held = held.withColumn("ord", F.substring("sid", 2, 1).cast("int"))
    return policy.decide(requests(spark, d), held, _buckets(spark)).select("request", "decision", F.coalesce("matched_by", F.lit("")).alias("matched_by"))


@query("user_statements", f"""WITH u AS (SELECT '{_USER}u' || c_custkey AS principal, c_custkey AS c, n_regionkey AS g FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT principal, 's1' AS sid FROM u WHERE c % 4 = 0 OR g = 1 UNION ALL SELECT principal, 's2' FROM u WHERE c % 4 = 1 UNION ALL SELECT principal, 's3' FROM u WHERE g = 0 UNION ALL SELECT principal, 's4' FROM u WHERE g = 1 UNION ALL SELECT principal, 's5' FROM u WHERE g = 2""")
def _statements(spark, d):
    return policy.attached(users(spark, d), groups(spark, d), documents(spark, DOCUMENTS)).select("principal", "sid")


@query("role_decisions", f"WITH {_DECIDED}, t AS (SELECT s.*, r.b, r.t, r.user_id FROM s JOIN r USING (request)) SELECT request, CASE WHEN (t.t <> 'view' AND user_id % 4 = 1 AND t.b < 10 AND (SELECT k FROM r WHERE r.request = t.request) BETWEEN 10 AND 19) OR b2 THEN 'ExplicitDeny' WHEN user_id % 4 < 2 AND t.t IN ('view', 'click') AND (t.b = 1 OR t.b >= 10) THEN 'Allow' WHEN b1 THEN 'Allow' ELSE 'ImplicitDeny' END AS decision FROM t")
def _roles(spark, d):
    """Temporary credentials of two roles; half of them bring an inline policy besides."""
    roles = spark.createDataFrame([("reader", ["p1"]), ("none", ["missing"])], "name string, policies array<string>")
    n = F.regexp_extract("principal", r"u(\d+)$", 1).cast("int") - 1
    credentials = requests(spark, d).select("principal").distinct().select("principal", F.when(n % 4 < 2, "reader").otherwise("none").alias("role"), F.when(n % 4 == 1, "p3").alias("inline"))
    held = policy.role_statements(credentials, roles, documents(spark, DOCUMENTS))
    return policy.decide(requests(spark, d), held, _buckets(spark)).select("request", "decision")


@query("requests_by_bucket_policy", f"WITH {_DECIDED} SELECT r.request, 'b' || b AS sid FROM r WHERE b BETWEEN 1 AND 4")
def _by_bucket(spark, d):
    """JOIN of requests with the policy of the bucket their resource names."""
    named = requests(spark, d).withColumn("bucket", network.parse_arn(F.col("resource")).bucket)
    return named.join(_buckets(spark), "bucket").select("request", "sid")


@query("user_of_active_key", f"SELECT '{_USER}u' || c_custkey AS name, 'AKA' || c_custkey AS id FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT '{_USER}u' || c_custkey, 'AKB' || c_custkey FROM customer WHERE c_custkey % 3 = 0")
def _by_key(spark, d):
    """The inverse of users' access keys."""
    return users(spark, d).select("name", F.explode("access_keys").alias("k")).where("k.status = 'Active'").select("name", "k.id")


@query("create_users", f"SELECT '{_USER}u' || s_suppkey * 10 AS name, CASE WHEN s_suppkey * 10 IN (SELECT c_custkey FROM customer) THEN 'exists' ELSE 'created' END AS outcome FROM supplier")
def _create(spark, d):
    new = table(spark, d, "supplier").select(F.concat(F.lit(f"{_USER}u"), F.col("s_suppkey") * 10).alias("name"))
    return tables.create(users(spark, d), new, "name")[1]


def membership(spark: SparkSession, d: str) -> DataFrame:
    return users(spark, d).select(F.explode("groups").alias("group"), F.col("name").alias("member"))


@query("delete_users", "SELECT 'g' || c_nationkey AS \"group\", count(*) AS members FROM customer WHERE c_acctbal >= 0 GROUP BY 1")
def _delete(spark, d):
    """Users without credit go, from their groups first."""
    gone = table(spark, d, "customer").where("c_acctbal < 0").select(F.concat(F.lit(f"{_USER}u"), "c_custkey").alias("member"))
    return tables.delete(membership(spark, d), gone, "member").groupBy("group").agg(F.count("*").alias("members"))


@query("deactivate_keys", f"SELECT '{_USER}u' || c_custkey AS name, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 5 <> 0 THEN 'Active' ELSE 'Inactive' END || ',' || CASE WHEN c_custkey % 3 = 0 THEN 'Active' ELSE 'Inactive' END AS states FROM customer")
def _deactivate(spark, d):
    """The first key of every fifth user is switched off."""
    number = F.regexp_extract("name", r"u(\d+)$", 1).cast("long")
    off = lambda k: F.struct(k.id.alias("id"), F.when((number % 5 == 0) & k.id.startswith("AKA"), "Inactive").otherwise(k.status).alias("status"))
    return users(spark, d).select("name", F.array_join(F.transform(F.transform("access_keys", off), lambda k: k.status), ",").alias("states"))


@query("attach_policies", "SELECT 'g' || n_nationkey AS name, CASE n_regionkey WHEN 0 THEN 'p3' WHEN 1 THEN 'p4,p1' WHEN 2 THEN 'p5' ELSE '' END || CASE WHEN n_nationkey % 2 = 0 AND n_regionkey <> 1 THEN CASE WHEN n_regionkey IN (0, 2) THEN ',p1' ELSE 'p1' END ELSE '' END AS policies FROM nation")
def _attach(spark, d):
    """p1 is attached to every second group; a policy that doesn't exist isn't."""
    names = groups(spark, d).where(F.regexp_extract("name", r"(\d+)$", 1).cast("int") % 2 == 0).select("name")
    wanted = names.withColumn("policy", F.explode(F.array(F.lit("p1"), F.lit("missing"))))
    made = tables.attach(groups(spark, d), wanted, documents(spark, DOCUMENTS), "name", "policies", "policy")
    return made.select("name", F.array_join("policies", ",").alias("policies"))


@query("detach_policies", f"SELECT '{_USER}u' || c_custkey AS name, CASE WHEN c_custkey % 4 = 0 AND c_nationkey <> 3 THEN 'p1' WHEN c_custkey % 4 = 1 THEN 'p2,missing' ELSE '' END AS policies FROM customer")
def _detach(spark, d):
    u = users(spark, d)
    wanted = u.where("groups[0] = 'g3'").select("name", F.lit("p1").alias("policy"))
    return tables.detach(u, wanted, "name", "policies", "policy").select("name", F.array_join("policies", ",").alias("policies"))


@query("inline_policies", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'new' ELSE n_name END AS document FROM nation WHERE n_nationkey <> 4 UNION ALL SELECT 100, 'new'")
def _inline(spark, d):
    """Inline policies by id: some are written over, one is added, one deleted."""
    held = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("document"))
    rows = held.where("id % 3 = 0").select("id").unionAll(spark.range(1).select(F.lit(100).alias("id"))).select("id", F.lit("new").alias("document"))
    return tables.delete(tables.upsert(held, rows, "id"), held.where("id = 4"), "id")


@query("capability_flags", "SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') AS view_status, c_mktsegment = 'BUILDING' AS manage_users, c_mktsegment IN ('BUILDING', 'MACHINERY') AS run_tiering, c_mktsegment IN ('BUILDING', 'MACHINERY') AS view_logs, c_mktsegment = 'BUILDING' AS manage_keys FROM customer")
def _flags(spark, d):
    role = F.when(F.col("c_mktsegment") == "BUILDING", "admin").when(F.col("c_mktsegment") == "MACHINERY", "operator").when(F.col("c_mktsegment") == "HOUSEHOLD", "viewer").otherwise("guest")
    return policy.capabilities(table(spark, d, "customer").select("c_custkey", role.alias("role"))).select("c_custkey", "view_status", "manage_users", "run_tiering", "view_logs", "manage_keys")


def _permissions():
    """Columns of a customer as permissions: a role, a global list, and a map of buckets' lists."""
    n = F.col("c_custkey")
    lists = F.when(n % 3 == 0, F.array(F.lit("read"))).when(n % 3 == 1, F.array(F.lit("read"), F.lit("write"))).otherwise(F.array().cast("array<string>"))
    by_bucket = F.when(n % 5 == 0, F.create_map(F.lit("src1"), F.array(F.lit("*")))).when(n % 5 == 1, F.create_map(F.lit("*"), F.array(F.lit("delete")))).when(n % 5 == 2, F.create_map(F.lit("src1"), F.array().cast("array<string>"))).otherwise(F.create_map().cast("map<string,array<string>>"))
    return F.when(n % 17 == 0, "admin").otherwise("user"), lists, by_bucket


_ACTIONS = "(VALUES ('read'), ('write'), ('delete'), ('list')) AS a(action)"


@query("access_policy", f"SELECT c_custkey, action, c_custkey % 17 = 0 OR (c_custkey % 3 < 2 AND action IN ('read', 'list')) OR (c_custkey % 3 = 1 AND action = 'write') OR (c_custkey % 5 = 0 AND action <> 'list') OR (c_custkey % 5 = 1 AND action = 'delete') AS allowed FROM customer, {_ACTIONS}")
def _access(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.explode(F.array(*[F.lit(a) for a in ("read", "write", "delete", "list")])).alias("action"))
    return rows.select("c_custkey", "action", policy.access_policy(*_permissions(), F.lit("src1"), F.col("action")).alias("allowed"))


@query("legacy_access", f"SELECT c_custkey, action, c_custkey % 17 = 0 OR CASE c_custkey % 5 WHEN 0 THEN true WHEN 1 THEN action = 'delete' ELSE (c_custkey % 3 < 2 AND action = 'read') OR (c_custkey % 3 = 1 AND action = 'write') END AS allowed FROM customer, {_ACTIONS}")
def _legacy(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.explode(F.array(*[F.lit(a) for a in ("read", "write", "delete", "list")])).alias("action"))
    return rows.select("c_custkey", "action", policy.legacy_allowed(*_permissions(), F.lit("src1"), F.col("action")).alias("allowed"))


@query("encryption_policy", "SELECT doc_id, CASE WHEN source IN ('src1', 'src2') OR doc_id % 11 = 0 THEN true WHEN source IN ('src3') OR n_chars <= 1024 THEN false ELSE true END AS required FROM documents")
def _encryption(spark, d):
    bucket = F.when(F.col("bucket") == "src1", "secrets").when(F.col("bucket") == "src2", "private").when(F.col("bucket") == "src3", "assets").otherwise(F.col("bucket"))
    return objects(spark, d).select("doc_id", policy.encryption_required(bucket, F.col("doc_id") % 11 == 0, F.col("size")).alias("required"))


@query("vector_access", "SELECT c_custkey, action, c_custkey % 17 = 0 OR (action = 'vector:Search' AND c_custkey % 3 < 2 AND c_custkey % 5 = 0) OR (action = 'vector:Index' AND c_custkey % 3 = 1 AND c_custkey % 5 = 0) AS allowed FROM customer, (VALUES ('vector:Search'), ('vector:Index'), ('vector:Manage')) AS a(action)")
def _vector(spark, d):
    role, lists, by_bucket = _permissions()
    there = F.col("c_custkey") % 5 == 0
    rows = table(spark, d, "customer").select("*", F.explode(F.array(*[F.lit(a) for a in ("vector:Search", "vector:Index", "vector:Manage")])).alias("action"))
    return rows.select("c_custkey", "action", policy.vector_policy(role, lists, there, there, there, F.col("action")).alias("allowed"))


@query("canned_acls", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'public-read-write' WHEN 1 THEN 'public-read' WHEN 2 THEN 'private' WHEN 3 THEN 'authenticated-read' ELSE 'private' END AS acl, doc_id % 6 < 2 AS public, CASE doc_id % 6 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 3 THEN 2 ELSE 1 END AS grants FROM documents")
def _acls(spark, d):
    c = F.col("doc_id") % 6
    grant = lambda who, what: F.struct(F.lit(who).alias("grantee"), F.lit(what).alias("permission"))
    sent = F.when(c == 0, F.array(grant("AllUsers", "READ"), grant("AllUsers", "WRITE"))).when(c == 1, F.array(grant("AllUsers", "READ"), grant("u", "WRITE"))).when(c == 2, F.array(grant("AllUsers", "WRITE")))
    header = F.when(c == 3, "authenticated-read").when(c == 4, "secret").otherwise("")
    rows = table(spark, d, "documents").select("doc_id", policy.acl_of(header, sent).alias("acl"))
    return rows.select("doc_id", "acl", policy.public_read(F.col("acl")).alias("public"), F.size(policy.grants_of(F.col("acl"), F.lit("o"))).alias("grants"))


@query("token_outcomes", f"SELECT o_orderkey, CASE WHEN TIMESTAMP '1996-01-01' > o_orderdate + INTERVAL 30 DAY THEN 'expired' WHEN o_orderkey % 5 <> 2 THEN 'type' WHEN o_orderstatus = 'P' THEN 'revoked' ELSE 'valid' END AS outcome, o_orderkey % 3 < 2 AND TIMESTAMP '1996-01-01' <= o_orderdate + INTERVAL 30 DAY AS delegated FROM orders")
def _tokens(spark, d):
    now, expires, n = F.lit("1996-01-01").cast("timestamp_ntz"), F.col("o_orderdate") + F.expr("INTERVAL '30' DAY"), F.col("o_orderkey")
    operations = F.when(n % 3 == 0, F.array(F.lit("*"))).when(n % 3 == 1, F.array(F.lit("put"), F.lit("get"))).otherwise(F.array(F.lit("put")))
    return table(spark, d, "orders").select("o_orderkey", policy.token_outcome(n % 5, expires, F.col("o_orderstatus") == "P", now, F.lit(2)).alias("outcome"), policy.delegation_allows(operations, F.lit("get"), expires, now).alias("delegated"))


@query("signed_requests", f"SELECT event_id, abs(epoch(TIMESTAMP '{AS_OF}' - (ts + INTERVAL 2 DAY))) <= 900 * 96 AND event_id % 4 <> 0 AS fresh, ts + to_seconds(user_id * 1000) >= TIMESTAMP '2024-01-20' AS presigned FROM events")
def _signed(spark, d):
    sent = F.col("ts") + F.expr("INTERVAL '2' DAY")
    date = F.when(F.col("event_id") % 4 == 0, "20000101").otherwise(F.date_format(sent, "yyyyMMdd"))
    return table(spark, d, "events").select("event_id", network.request_fresh(sent, F.lit(AS_OF).cast("timestamp_ntz"), date, 15 * 96).alias("fresh"), network.presigned_valid(F.col("ts"), F.col("user_id") * 1000, F.lit("2024-01-20").cast("timestamp_ntz")).alias("presigned"))


@query("cidr_members", "SELECT event_id, CASE user_id % 4 WHEN 0 THEN user_id % 200 < 64 WHEN 1 THEN user_id % 200 = 5 WHEN 2 THEN true ELSE false END AS inside FROM events")
def _cidr(spark, d):
    u = F.col("user_id")
    block = F.when(u % 4 == 0, "10.0.0.0/26").when(u % 4 == 1, "10.0.0.5").when(u % 4 == 2, "*").otherwise("10.0.0.0/99")
    return table(spark, d, "events").select("event_id", network.in_cidr(F.concat(F.lit("10.0.0."), u % 200), block).alias("inside"))


#: Endpoint, allowed without and with private addresses.
ENDPOINTS = (("https://replica.example.com/base", True, True), ("http://203.0.113.7:9000", True, True), ("ftp://replica.example.com", False, False), ("https://", False, False), ("http://localhost:9000", False, False), ("http://127.0.0.1", False, False), ("http://127.8.9.10:80/x", False, False), ("http://0.0.0.0", False, False), ("http://10.1.2.3", False, True), ("http://172.16.0.9", False, True), ("http://172.32.0.9", True, True), ("http://192.168.1.1:9000/a?b", False, True), ("http://169.254.169.254/latest", False, True), ("http://[::1]:9000", False, False), ("http://[fe80::1]", False, True), ("http://[fd00::1]/x", False, True), ("http://[::ffff:127.0.0.1]/", False, False), ("http://user@127.0.0.1/", False, False))


@query("endpoint_guard", "WITH e(url, strict, loose) AS (VALUES " + ", ".join(f"('{u}', {a}, {b})" for u, a, b in ENDPOINTS) + ") SELECT n_nationkey, url, strict, loose FROM nation, e")
def _endpoints(spark, d):
    """Every nation's rule names every endpoint."""
    urls = F.explode(F.array(*[F.lit(u) for u, _, _ in ENDPOINTS])).alias("url")
    rows = table(spark, d, "nation").select("n_nationkey", urls)
    return rows.select("n_nationkey", "url", network.endpoint_allowed(F.col("url")).alias("strict"), network.endpoint_allowed(F.col("url"), True).alias("loose"))


@query("arn_round_trip", "SELECT doc_id, 's3' AS service, source AS bucket, lang || '/' || doc_id AS key FROM documents")
def _arns(spark, d):
    name = network.arn(F.lit("s3"), F.concat_ws("/", "bucket", "key"))
    return objects(spark, d).select("doc_id", network.parse_arn(name).alias("a")).select("doc_id", "a.*")


@query("page_hosts", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS host, regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS client FROM pages")
def _hosts(spark, d):
    host = network.host_of(F.col("url"))
    return table(spark, d, "pages").select("page_id", host.alias("host"), network.client_address(F.when(F.col("page_id") % 2 == 0, F.concat(host, F.lit(", 10.0.0.1"))), F.concat(host, F.lit(":443"))).alias("client"))


@query("role_durations", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 3600 WHEN c_custkey * 40 <= 3600 THEN c_custkey * 40 ELSE 3600 END AS granted, least(c_custkey * 4000, 129600) AS session, least(c_custkey * 4000, 43200) AS federation FROM customer")
def _durations(spark, d):
    n = F.col("c_custkey")
    asked = F.when(n % 5 == 0, 0).otherwise(n * 40)
    return table(spark, d, "customer").select("c_custkey", policy.role_duration(asked, F.lit(3600)).alias("granted"), policy.capped(n * 4000, policy.SESSION_CAP).alias("session"), policy.capped(n * 4000, policy.FEDERATION_CAP).alias("federation"))


@query("cors_requests", "SELECT event_id, CASE user_id % 3 WHEN 0 THEN true WHEN 1 THEN user_id % 7 < 2 ELSE false END AS allowed FROM events")
def _cors(spark, d):
    u = F.col("user_id")
    allowed = F.when(u % 3 == 0, F.array(F.lit("https://x.example"), F.lit("*"))).when(u % 3 == 1, F.array(F.lit("https://a0.example"), F.lit("https://a1.example"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "events").select("event_id", policy.origin_allowed(F.concat(F.lit("https://a"), u % 7, F.lit(".example")), allowed).alias("allowed"))


@query("action_kinds", "SELECT event_id, event_type IN ('view', 'click', 'error') AS admin, event_type = 'signup' AS vector FROM events")
def _kinds(spark, d):
    t = F.col("event_type")
    action = F.concat(F.when(t == "view", "iam").when(t == "click", "sts").when(t == "error", "admin").when(t == "signup", "vector").otherwise("s3"), F.lit(":"), t)
    return table(spark, d, "events").select("event_id", policy.is_admin_action(action).alias("admin"), policy.is_vector_action(action).alias("vector"))


@query("default_limits", "SELECT event_type AS api, count(*) AS n, CASE event_type WHEN 'purchase' THEN 100 WHEN 'error' THEN 500 WHEN 'signup' THEN 10 WHEN 'click' THEN 1000 ELSE -1 END AS rate, CASE event_type WHEN 'purchase' THEN 20 WHEN 'error' THEN 50 WHEN 'signup' THEN 5 WHEN 'click' THEN 100 ELSE -1 END AS burst FROM events GROUP BY event_type")
def _limits(spark, d):
    """Calls with the limits of their kind; one kind has none."""
    t = F.col("event_type")
    api = F.when(t == "purchase", "PUT").when(t == "error", "DELETE").when(t == "signup", "CREATE_BUCKET").when(t == "click", "GET").otherwise("COPY")
    made = table(spark, d, "events").select(t.alias("api"), policy.limit_of(api).alias("l"))
    return made.groupBy("api").agg(F.count("*").alias("n"), F.coalesce(F.max("l.rate"), F.lit(-1)).alias("rate"), F.coalesce(F.max("l.burst"), F.lit(-1)).alias("burst"))
