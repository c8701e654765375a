"""Client / account link operators: linked clients and owner-user pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Link roles after recoding.
OWNER, USER = "OWNER", "USER"


def link_clients(disp: DataFrame, clients: DataFrame) -> DataFrame:
    """Link rows left-joined to their client's attributes."""
    c = clients.select("client_id", "district_id", "birth_date", "sex")
    return (disp.select("account_id", "client_id", "type_")
                .join(c, on="client_id", how="left")
                .select("account_id", "client_id", "district_id", "type_", "birth_date", "sex"))


def role_filter(client_disp: DataFrame, role: str) -> DataFrame:
    return client_disp.filter(F.col("type_") == role)


def pair_roles(client_disp: DataFrame, literal: bool = False) -> DataFrame:
    """One row per account: owner fields, user fields and the client count.

    Default: a single aggregate per account (one shuffle, partial aggregation
    on the map side, so a huge account cannot overload one task).  Each
    account has exactly one owner; the user is the one with the smallest
    client id when there are several.

    ``literal=True`` follows the source text: owner rows left-joined to user
    rows and to the client count, where a missing comma turns the count into
    ``user_client_id`` and the real user id is lost.
    """
    if literal:
        return _pair_roles_literal(client_disp)
    role = F.col("type_")
    owner = F.struct(F.col("client_id"), F.col("district_id"), F.col("birth_date"), F.col("sex"))
    user = F.struct(F.col("client_id"), F.col("district_id"), F.col("birth_date"), F.col("sex"))
    agg = client_disp.groupBy("account_id").agg(
        F.min(F.when(role == OWNER, owner)).alias("_o"),
        F.min(F.when(role == USER, user)).alias("_u"),
        F.count(F.lit(1)).alias("n_clients"),
        F.count_if(role == OWNER).alias("_n_owner"))
    return (agg.filter(F.col("_n_owner") > 0)
               .select("account_id",
                       F.col("_o.client_id").alias("client_id"),
                       F.col("_o.district_id").alias("client_district_id"),
                       F.col("_o.birth_date").alias("birth_date"),
                       F.col("_o.sex").alias("sex"),
                       "n_clients",
                       F.col("_u.client_id").alias("user_client_id"),
                       F.col("_u.district_id").alias("user_district_id"),
                       F.col("_u.birth_date").alias("user_bday"),
                       F.col("_u.sex").alias("user_sex")))


def _pair_roles_literal(client_disp: DataFrame) -> DataFrame:
    o = role_filter(client_disp, OWNER).select(
        "account_id", "client_id", F.col("district_id").alias("client_district_id"),
        "birth_date", "sex")
    u = role_filter(client_disp, USER).select(
        F.col("account_id"),
        F.col("district_id").alias("user_district_id"),
        F.col("birth_date").alias("user_bday"),
        F.col("sex").alias("user_sex"))
    n = client_disp.groupBy("account_id").agg(F.count(F.lit(1)).alias("user_client_id"))
    return (o.join(u, on="account_id", how="left")
             .join(n, on="account_id", how="left")
             .select("account_id", "client_id", "client_district_id", "birth_date", "sex",
                     "user_client_id", "user_district_id", "user_bday", "user_sex"))
