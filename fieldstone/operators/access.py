"""Row and attribute access: tenants, visibility, policy rules, redaction."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Caller:
    """Who asks: the team, the person (None sees nothing), the channel, human or agent, the organisation, the person's role and, of an
    agent, its app and name."""

    team: str
    principal: str | None
    channel: str = "human"
    organization: str | None = None
    role: str | None = None
    app: str | None = None
    agent: str | None = None


def live(df: DataFrame, deleted: bool = False) -> DataFrame:
    """Rows that are neither merged nor erased, and not deleted (or only deleted ones)."""
    gone = F.col("deleted_at").isNotNull()
    return df.filter(F.col("merged_into_id").isNull() & F.col("erased_at").isNull() & (gone if deleted else ~gone))


def visible(df: DataFrame, grants: DataFrame, caller: Caller, id_col: str = "id") -> DataFrame:
    """Rows of team visibility, the caller's own, and those shared with the caller; applied before any limit, rank or aggregate."""
    if caller.principal is None:
        return df.filter(F.lit(False))
    shared = grants.filter(F.col("user_id") == caller.principal).select(F.col("record_id").alias("__granted")).distinct()
    joined = df.join(shared, df[id_col] == F.col("__granted"), "left")
    return joined.filter((F.col("visibility") == "team") | (F.col("created_on_behalf_of") == caller.principal) | ((F.col("visibility") == "users") & F.col("__granted").isNotNull())).drop("__granted")


def _fold(rule_matches: Column, human: bool) -> Column:
    """A plain deny is final, then a deny with approval; else an allow must hold the highest allowing priority with no tie that needs approval.
    People without any rule may view, agents may not."""
    allow = rule_matches & (F.col("effect") == "allow")
    deny = rule_matches & (F.col("effect") == "deny")
    return F.struct(
        F.coalesce(F.bool_or(deny), F.lit(False)).alias("denied"),
        F.max(F.when(allow & ~F.col("requires_approval"), F.col("priority"))).alias("free"),
        F.max(F.when(allow & F.col("requires_approval"), F.col("priority"))).alias("held"),
        F.coalesce(F.bool_or(rule_matches), F.lit(False)).alias("any"),
    )


def decision(folded: Column, human: bool) -> Column:
    free, held = folded["free"], folded["held"]
    allowed = free.isNotNull() & (held.isNull() | (free > held))
    return F.when(folded["denied"], False).when(folded["any"], allowed).otherwise(F.lit(human))


def policy(df: DataFrame, rules: DataFrame, caller: Caller, id_col: str = "id", type_col: str = "object_type") -> DataFrame:
    """Rows that the caller's rules (scope, scope_id, effect, priority, requires_approval) let view. Team and type rules are few and fold to
    constants per type; only rules of single records are joined, pre-aggregated, by id."""
    of_record = rules.filter(F.col("scope") == "record").select(F.col("scope_id").alias("__id"), "effect", "priority", "requires_approval")
    wide = rules.filter(F.col("scope").isin("team", "object_type"))
    team = wide.filter((F.col("scope") == "team") & (F.col("scope_id") == caller.team)).select("effect", "priority", "requires_approval")
    types = wide.filter(F.col("scope") == "object_type").select(F.col("scope_id").alias("__type"), "effect", "priority", "requires_approval")
    human = caller.channel == "human"
    named = lambda d, key: d.groupBy(key).agg(_fold(F.lit(True), human).alias(f"{key}_fold"))
    everyone = team.agg(_fold(F.lit(True), human).alias("__team_fold"))
    joined = df.join(named(of_record, "__id"), df[id_col].cast("string") == F.col("__id"), "left").join(F.broadcast(named(types, "__type")), df[type_col] == F.col("__type"), "left").join(F.broadcast(everyone), F.lit(True), "left")
    parts = [F.col(f"{k}_fold") for k in ("__id", "__type", "__team")]
    either = lambda name: F.coalesce(*[F.when(p[name], True) for p in parts], F.lit(False))
    merged = F.struct(either("denied").alias("denied"), F.greatest(*[p["free"] for p in parts]).alias("free"), F.greatest(*[p["held"] for p in parts]).alias("held"), either("any").alias("any"))
    return joined.withColumn("__policy", merged).filter(decision(F.col("__policy"), human)).select(*df.columns)


def scoped(df: DataFrame, caller: Caller) -> DataFrame:
    """Rows of the caller's organisation and team: the first filter of every read, which reaches the scan."""
    return df.filter((F.col("organization_id") == caller.organization) & (F.col("team_id") == caller.team))


def bound_rules(rules: DataFrame, bindings: DataFrame, caller: Caller, agent: bool, resource: str = "record", action: str = "view", sensitivity: str | None = None) -> DataFrame:
    """The caller's rules on one side: those of the tenant, resource and action, bound to the person or the person's role, or with `agent`
    to the agent by name or by its app's wildcard. A rule with a condition holds only for that sensitivity of an attribute."""
    if agent:
        holds = (F.col("actor_type") == "agent") & F.col("actor_id").isin(f"agent:{caller.app}:{caller.agent}", f"agent:{caller.app}:*")
    else:
        holds = (F.col("actor_type") == "human") & (F.col("actor_id") == caller.principal)
        if caller.role is not None:
            holds = holds | (F.col("actor_type") == "role") & (F.col("actor_id") == caller.role)
    of = scoped(rules, caller).filter((F.col("resource_type") == resource) & (F.col("action") == action))
    of = of.filter(F.col("condition").isNull() if sensitivity is None else F.col("condition").isNull() | (F.col("condition") == sensitivity))
    return of.join(F.broadcast(bindings.filter(holds).select("rule_id").distinct()), "rule_id", "left_semi")


def permitted(df: DataFrame, rules: DataFrame, bindings: DataFrame, caller: Caller, id_col: str = "id", type_col: str = "object_type", resource: str = "record", sensitivity: str | None = None) -> DataFrame:
    """Rows that the person may view and, where an agent asks for the person, the agent too. People may view what no rule of theirs
    speaks of; an agent has no standing right."""
    out = policy(df, bound_rules(rules, bindings, caller, False, resource, sensitivity=sensitivity), replace(caller, channel="human"), id_col, type_col)
    return policy(out, bound_rules(rules, bindings, caller, True, resource, sensitivity=sensitivity), caller, id_col, type_col) if caller.channel == "agent" else out


def attribute_gate(df: DataFrame, rules: DataFrame, bindings: DataFrame, caller: Caller, sensitivities: list[str], id_col: str = "id", type_col: str = "object_type") -> DataFrame:
    """Rows of which every attribute that a filter or sort reads, given by its sensitivity, may be viewed."""
    for sensitivity in dict.fromkeys(sensitivities):
        df = permitted(df, rules, bindings, caller, id_col, type_col, "attribute", sensitivity)
    return df


def record_set(records: DataFrame, grants: DataFrame, rules: DataFrame, bindings: DataFrame, caller: Caller, object_type: str, deleted: bool = False, reads: list[str] | None = None, id_col: str = "id") -> DataFrame:
    """The records that a query starts from: the caller's tenant, one type, live (or deleted) ones, those visible to and permitted for the
    caller, and of these the ones whose attributes of the sensitivities `reads` may be viewed."""
    if caller.principal is None:
        return records.filter(F.lit(False))
    rows = live(scoped(records, caller).filter(F.col("object_type") == object_type), deleted)
    rows = permitted(visible(rows, grants, caller, id_col), rules, bindings, caller, id_col)
    return attribute_gate(rows, rules, bindings, caller, reads or [], id_col)


PEOPLE = ("member", "admin", "owner")
#: What a new team starts with (resource, action, effect, priority, needs approval, sensitivity, roles).
DEFAULTS = (
    ("record", "view", "allow", 0, False, None, PEOPLE),
    ("record", "create", "allow", 0, False, None, PEOPLE),
    ("record", "edit", "allow", 0, False, None, PEOPLE),
    ("record", "link", "allow", 0, False, None, PEOPLE),
    ("record", "delete", "deny", 0, True, None, ("member",)),
    ("record", "restore", "deny", 0, True, None, ("member",)),
    ("record", "delete", "allow", 0, False, None, ("admin", "owner")),
    ("record", "restore", "allow", 0, False, None, ("admin", "owner")),
    ("link", "link", "allow", 0, False, None, PEOPLE),
    ("list", "create", "allow", 0, False, None, PEOPLE),
    ("list", "edit", "allow", 0, False, None, PEOPLE),
    ("view", "create", "allow", 0, False, None, PEOPLE),
    ("schema", "define", "deny", 0, True, None, ("member",)),
    ("schema", "define", "allow", 0, False, None, ("admin", "owner")),
    ("merge", "merge", "deny", 0, True, None, ("member",)),
    ("merge", "merge", "allow", 0, False, None, ("admin", "owner")),
    ("export", "export", "deny", 0, True, None, ("member",)),
    ("export", "export", "allow", 0, False, None, ("admin", "owner")),
    ("webhook", "admin", "deny", 0, False, None, ("member",)),
    ("webhook", "admin", "allow", 0, True, None, ("admin", "owner")),
    ("approval", "admin", "allow", 0, False, None, ("admin", "owner")),
    ("attribute", "view", "deny", 10, False, "restricted", ("member",)),
    ("attribute", "view", "allow", 10, False, "restricted", ("admin", "owner")),
    ("attribute", "edit", "deny", 10, False, "confidential", ("member",)),
    ("attribute", "edit", "allow", 10, False, "confidential", ("admin", "owner")),
    ("contact_point", "edit", "allow", 0, False, None, PEOPLE),
    ("record", "erase", "deny", 0, True, None, ("member", "admin")),
    ("record", "erase", "allow", 0, True, None, ("owner",)),
    ("suppression", "view", "allow", 0, False, None, PEOPLE),
    ("suppression", "create", "allow", 0, False, None, PEOPLE),
    ("suppression", "admin", "deny", 0, False, None, ("member", "admin")),
    ("suppression", "admin", "allow", 0, True, None, ("owner",)),
)
#: What every agent of a trusted app may do.
AGENT_DEFAULTS = {
    "record": ("view", "create", "edit", "link", "delete", "restore", "erase"),
    "link": ("view", "link"),
    "list": ("view", "create", "edit"),
    "view": ("view", "create", "edit"),
    "schema": ("view", "define"),
    "attribute": ("view", "edit"),
    "contact_point": ("edit",),
    "merge": ("merge",),
    "export": ("export",),
    "webhook": ("admin",),
    "suppression": ("view", "create", "admin"),
    "approval": ("admin",),
}
#: What people may do where no rule of theirs speaks.
OPEN_ACTIONS = ("view", "create", "edit", "link")


def default_policies(spark: SparkSession, organization: str, team: str, apps: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rules, bindings) of a new team: of its roles, and of all agents of the apps named."""
    own = [(*d[:6], [("role", r) for r in d[6]]) for d in DEFAULTS]
    own += [(kind, action, "allow", 0, False, None, [("agent", f"agent:{app}:*")]) for app in apps for kind, actions in AGENT_DEFAULTS.items() for action in actions]
    rules = [(f"default-{i}", organization, team, kind, action, "team", team, effect, priority, held, condition) for i, (kind, action, effect, priority, held, condition, _) in enumerate(own)]
    bindings = [(f"default-{i}", *b) for i, d in enumerate(own) for b in d[6]]
    return (
        spark.createDataFrame(rules, "rule_id string, organization_id string, team_id string, resource_type string, action string, scope string, scope_id string, effect string, priority int, requires_approval boolean, condition string"),
        spark.createDataFrame(bindings, "rule_id string, actor_type string, actor_id string"),
    )


def evaluate(requests: DataFrame, rules: DataFrame, bindings: DataFrame) -> DataFrame:
    """requests (actor_type, actor_id, resource_type, action, sensitivity, ...) of one team with `outcome`: allow, approval or deny, by the
    team's rules that are bound to the actor. A plain deny is final, then one with approval asks for it; else the highest priority's
    allow decides, and of two alike the one with approval. Where no rule speaks, people may do what OPEN_ACTIONS names, agents nothing.
    Rules are a few per team and are folded before they meet the requests."""
    key = ["actor_type", "actor_id", "resource_type", "action"]
    bound = rules.filter("scope = 'team'").join(bindings, "rule_id")
    folds = bound.groupBy(*key, "condition").agg(
        F.bool_or((F.col("effect") == "deny") & ~F.col("requires_approval")).alias("denied"), F.bool_or((F.col("effect") == "deny") & F.col("requires_approval")).alias("asked"),
        F.max(F.when(F.col("effect") == "allow", F.struct("priority", "requires_approval"))).alias("best"),
    )
    general, special = folds.filter("condition is null").drop("condition"), folds.filter("condition is not null").withColumnRenamed("condition", "sensitivity")
    renamed = lambda d, p, on: d.select(*on, *[F.col(c).alias(f"__{p}_{c}") for c in ("denied", "asked", "best")], F.lit(True).alias(f"__{p}"))
    out = requests.join(F.broadcast(renamed(general, "g", key)), key, "left").join(F.broadcast(renamed(special, "s", [*key, "sensitivity"])), [*key, "sensitivity"], "left")
    either = lambda c: F.coalesce(F.col(f"__g_{c}"), F.lit(False)) | F.coalesce(F.col(f"__s_{c}"), F.lit(False))
    best = F.greatest("__g_best", "__s_best")
    silent = F.when((F.col("actor_type") != "agent") & F.col("action").isin(*OPEN_ACTIONS), "allow").otherwise("deny")
    outcome = F.when(either("denied"), "deny").when(either("asked"), "approval").when(best.isNotNull(), F.when(best["requires_approval"], "approval").otherwise("allow")).otherwise(silent)
    return out.withColumn("outcome", outcome).select(*requests.columns, "outcome")


def redact(df: DataFrame, sensitivity: dict[str, str], allowed: set[str]) -> DataFrame:
    """Null for attributes of a sensitivity that isn't allowed, whose names are listed in redacted_attributes."""
    hidden = sorted(c for c, s in sensitivity.items() if s not in allowed)
    return df.select(*[F.lit(None).cast(df.schema[c].dataType).alias(c) if c in hidden else F.col(c) for c in df.columns], F.array(*map(F.lit, hidden)).cast("array<string>").alias("redacted_attributes"))
