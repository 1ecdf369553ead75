"""Tenant, scope and role predicates. Whatever isn't granted is denied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_tenant(chunk_tenant: Column, tenant: Column) -> Column:
    """No tenant asks for everything; a chunk without one is never in any."""
    return tenant.isNull() | F.coalesce((chunk_tenant == tenant) & (chunk_tenant != ""), F.lit(False))


def in_scope(doc_id: Column, scope: Column) -> Column:
    """A null scope is open, an empty one holds nothing."""
    return scope.isNull() | F.coalesce(F.array_contains(scope, doc_id), F.lit(False))


def accessible(documents: DataFrame, acl: DataFrame, role: str, admin: bool = False) -> DataFrame:
    """documents that a role may read: all of them for an admin, else those with a grant for the role or for anyone."""
    if admin:
        return documents
    grants = acl.filter(F.col("role").isin(role, "*") & F.col("allow_read"))
    return documents.join(grants, "doc_id", "left_semi")


def denied(asked: DataFrame, documents: DataFrame) -> DataFrame:
    """The asked doc_ids that aren't among the accessible documents."""
    return asked.join(documents.select("doc_id"), "doc_id", "left_anti")


def resolve_scope(asked: DataFrame | None, documents: DataFrame) -> DataFrame:
    """The doc_ids to search: those asked for, if every one is accessible, else an error; without any, all accessible."""
    if asked is None:
        return documents.select("doc_id")
    if not denied(asked, documents).isEmpty():
        raise PermissionError("a document of the request doesn't exist or isn't accessible")
    return asked.select("doc_id").distinct()


def owned(conversations: DataFrame, conv_id: object, user: str, tenant: str) -> DataFrame:
    """A conversation only for its user in its tenant."""
    return conversations.filter((F.col("conv_id") == conv_id) & (F.col("username") == user) & (F.col("tenant_id") == tenant))


def active_user(users: DataFrame, username: str) -> DataFrame:
    """The user of that name, if active."""
    return users.filter((F.col("username") == username) & F.col("is_active"))


def role_allowed(role: Column, *allowed: str) -> Column:
    """Whether a role may do what the allowed roles may; an admin may do all, no role nothing."""
    return F.coalesce((role == "admin") | role.isin(*allowed), F.lit(False))


def under(path: Column, root: str) -> Column:
    """Whether a storage path lies below root, dots resolved by refusing them."""
    return path.startswith(root.rstrip("/") + "/") & ~F.array_contains(F.split(path, "/"), "..")


def last_rows(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key in the given order."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
