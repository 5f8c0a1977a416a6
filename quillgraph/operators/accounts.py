"""Users, sessions, tokens, shares, membership, comments, templates, and single-row changes as rewrites."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions.text import substituted
from quillgraph.operators.predicates import live, subtree


def valid(rows: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    """Sessions, tokens or links that have not expired; a null time never does."""
    return rows.where(F.col(expires).isNull() | (F.col(expires) > now))


def scope_of(path: Column, method: Column) -> Column:
    """resource:read or resource:write, the resource being the path's first part."""
    return F.concat(F.regexp_extract(path, "^/?([^/?]*)", 1), F.when(method.isin("GET", "HEAD"), ":read").otherwise(":write"))


def allowed(calls: DataFrame, tokens: DataFrame, now: Column) -> DataFrame:
    """Calls (token_hash, path, method) whose valid token has just that scope."""
    t = valid(tokens, now).select("token_hash", "scopes")
    return calls.join(t, "token_hash").where(F.array_contains("scopes", scope_of(F.col("path"), F.col("method")))).select(*calls.columns)


def by_email(users: DataFrame, email: str) -> DataFrame:
    return users.where(F.lower("email") == email.lower())


def members(users: DataFrame, membership: DataFrame, ws) -> DataFrame:
    return users.join(membership.where(F.col("ws") == ws), "user_id", "left_semi")


def archived(pages: DataFrame, page_id: int) -> DataFrame:
    return pages.withColumn("archived", F.col("archived") | (F.col("page_id") == page_id))


def renamed(pages: DataFrame, page_id: int, title: str) -> DataFrame:
    return pages.withColumn("title", F.when(F.col("page_id") == page_id, F.lit(title)).otherwise(F.col("title")))


def read_shared(pages: DataFrame, blocks: DataFrame, links: DataFrame, token_hash: str, now: Column) -> DataFrame:
    """(page_id, title, block_index, text) of a share's pages, those without blocks too; nothing for a link that has expired."""
    link = valid(links.where(F.col("token_hash") == token_hash), now).first()
    if link is None:
        ids = pages.limit(0).select("page_id")
    elif link["include_descendants"]:
        ids = subtree(pages, link["page_id"])
    else:
        ids = live(pages).where(F.col("page_id") == link["page_id"]).select("page_id")
    shown = pages.join(ids, "page_id", "left_semi").select("page_id", "title")
    return shown.join(blocks.select("page_id", "block_index", "text"), "page_id", "left").orderBy("page_id", "block_index")


def resolved_thread(comments: DataFrame, comment_id: int) -> DataFrame:
    """A comment and its direct replies."""
    hit = (F.col("comment_id") == comment_id) | F.col("parent_id").eqNullSafe(F.lit(comment_id))
    return comments.withColumn("resolved", F.col("resolved") | hit)


def mentions(comments: DataFrame, mentioned: DataFrame, pages: DataFrame, user_id: int, limit: int = 50) -> DataFrame:
    """Comments that mention a user, on live pages, newest first."""
    c = comments.join(mentioned.where(F.col("user_id") == user_id).select("comment_id"), "comment_id", "left_semi").join(live(pages).select("page_id"), "page_id", "left_semi")
    return c.orderBy(F.desc("created_at"), F.desc("comment_id")).limit(limit)


def anchored(comments: DataFrame, blocks: DataFrame) -> DataFrame:
    """comment_id, at: where a comment's quote is in its block, from 0; null if the text has moved on."""
    at = F.instr(F.col("text"), F.col("quote")) - 1
    return comments.join(blocks.select("page_id", "block_index", "text"), ["page_id", "block_index"], "left").select("comment_id", F.when(at >= 0, at).alias("at"))


def saved_template(blocks: DataFrame, page_id: int, title: str) -> DataFrame:
    """title, blocks (kind, text) in order."""
    b = F.transform(F.array_sort(F.collect_list(F.struct("block_index", "kind", "text"))), lambda x: F.struct(x["kind"].alias("kind"), x["text"].alias("text")))
    return blocks.where(F.col("page_id") == page_id).agg(b.alias("blocks")).select(F.lit(title).alias("title"), "blocks")


def instantiated(template: DataFrame, values: Mapping[str, str]) -> DataFrame:
    """title, block_index, kind, text with known keys filled in."""
    v = {k: F.lit(x) for k, x in values.items()}
    rows = template.select(substituted(F.col("title"), v).alias("title"), F.posexplode("blocks").alias("block_index", "b"))
    return rows.select("title", "block_index", F.col("b.kind").alias("kind"), substituted(F.col("b.text"), v).alias("text"))


def linked(links: DataFrame, pages: DataFrame, source: str = "from_page", target: str = "to_page") -> DataFrame:
    """Links with both ends live and in one workspace; the two columns swapped give the way back."""
    p = live(pages)
    a, b = p.select(F.col("page_id").alias(source), F.col("ws").alias("_a")), p.select(F.col("page_id").alias(target), F.col("ws").alias("_b"))
    out = links.join(a, source).join(b, target).where(F.col("_a") == F.col("_b"))
    return out.select(source, target, F.row_number().over(W.partitionBy(source).orderBy("created_at", target)).alias("place"))


def rollup_dependents(links: DataFrame, rollups: DataFrame, changed: int) -> DataFrame:
    """(rollup, page) to compute anew when a page has changed: pages linked to it by the rollup's relation, one step back."""
    via = F.get_json_object("config", "$.via")
    return links.where(F.col("to_page") == changed).join(rollups.select("rollup", via.alias("property_id")), "property_id").select("rollup", F.col("from_page").alias("page")).distinct()
