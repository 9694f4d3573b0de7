"""Workspaces and their members as two small tables, with the guards on changing them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import without_accents
from weftgraph.operators.lookup import NEEDED, ROLES


class Refused(ValueError):
    """A change that is not allowed."""


def slugged(name: str) -> str:
    return re.sub("[^a-z0-9]+", "-", (without_accents(name) or "").strip()).strip("-")


def may(roles: dict[str, str], workspace: str, action: str, super_admin: bool = False) -> bool:
    """Whether an actor's role in a workspace suffices for an action."""
    rank = {r: i for i, r in enumerate(ROLES)}
    return super_admin or rank.get(roles.get(workspace, ""), -1) >= rank[NEEDED[action]]


def listed(registry: DataFrame, contexts: DataFrame, roles: DataFrame, super_admin: bool = False) -> DataFrame:
    """(id, displayName, role, contexts) of registered and installed workspaces that an actor may see, by id.

    registry (id, displayName), contexts (workspace, grade, subject), roles (workspace, role).
    """
    ids = registry.select("id").unionByName(contexts.select(F.col("workspace").alias("id"))).distinct()
    mine = F.array_sort(F.collect_list(F.struct("grade", "subject"))).alias("contexts")
    rows = ids.join(registry, "id", "left").join(roles.select(F.col("workspace").alias("id"), "role"), "id", "left").join(contexts.groupBy(F.col("workspace").alias("id")).agg(mine), "id", "left")
    rows = rows.withColumn("displayName", F.coalesce("displayName", "id")).withColumn("role", F.lit("super_admin") if super_admin else F.col("role"))
    seen = rows if super_admin else rows.where("role IS NOT NULL")
    visible = F.coalesce(F.when(F.col("role").isNotNull(), F.col("contexts")), F.array().cast("array<struct<grade:string,subject:string>>"))
    return seen.withColumn("contexts", visible).select("id", "displayName", "role", "contexts").orderBy("id")


def created(registry: DataFrame, name: str, display_name: str) -> DataFrame:
    """The registry with a new workspace."""
    key = slugged(name)
    if not key:
        raise Refused("no letters or digits in the name")
    if registry.where(F.col("id") == key).take(1):
        raise Refused(f"workspace {key!r} exists")
    return registry.unionByName(registry.sparkSession.createDataFrame([(key, display_name)], "id string, displayName string"))


def granted(members: DataFrame, known: DataFrame, workspace: str, user: str, role: str) -> DataFrame:
    """Members (workspace, userId, role) with a role given; ``known`` has the workspaces' ids."""
    key = slugged(workspace)
    if role not in ROLES[:-1]:
        raise Refused(f"unknown role {role!r}")
    if not known.where(F.col("id") == key).take(1):
        raise Refused(f"unknown workspace {key!r}")
    kept = members.where(~((F.col("workspace") == key) & (F.col("userId") == user)))
    return kept.unionByName(members.sparkSession.createDataFrame([(key, user, role)], "workspace string, userId string, role string"))


def revoked(members: DataFrame, workspace: str, user: str) -> DataFrame:
    """Members without one; the last admin of a workspace stays."""
    key = slugged(workspace)
    target = members.where((F.col("workspace") == key) & (F.col("userId") == user)).take(1)
    if not target:
        raise Refused(f"{user!r} is no member of {key!r}")
    if target[0].role == "admin" and members.where((F.col("workspace") == key) & (F.col("role") == "admin")).count() <= 1:
        raise Refused(f"the last admin of {key!r} stays")
    return members.where(~((F.col("workspace") == key) & (F.col("userId") == user)))


def members_of(members: DataFrame, workspace: str) -> DataFrame:
    return members.where(F.col("workspace") == slugged(workspace)).orderBy("userId")


def of_user(members: DataFrame, user: str) -> DataFrame:
    """A user's memberships, by workspace."""
    return members.where(F.col("userId") == user).orderBy("workspace")


def member(members: DataFrame, workspace: str, user: str) -> DataFrame:
    """The one membership of a user in a workspace, or no row."""
    return members.where((F.col("workspace") == slugged(workspace)) & (F.col("userId") == user)).limit(1)


def capabilities(roles: DataFrame) -> DataFrame:
    """(workspace, action, allowed): what each role suffices for; the actions are a fixed short list."""
    rank = lambda c: F.coalesce(*(F.when(c == r, i) for i, r in enumerate(ROLES)), F.lit(-1))
    needs = F.explode(F.array(*(F.struct(F.lit(a).alias("action"), F.lit(r).alias("needed")) for a, r in NEEDED.items()))).alias("x")
    return roles.select("workspace", "role", needs).select("workspace", "x.action", (rank(F.col("role")) >= rank(F.col("x.needed"))).alias("allowed"))
