"""Repositories to directory trees with summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import repo
from ..reasoner import RuleReasoner
from ..staging import staged


def build(files: DataFrame, texts: DataFrame | None = None, include: list[str] | None = None, exclude: list[str] | None = None, reasoner: RuleReasoner | None = None) -> DataFrame:
    """The flat index of ``files`` (repo_id, path), with summaries if there is a reasoner.

    ``texts`` (repo_id, path, text) has the files that describe directories.  Summaries are made from the deepest
    directories up, all of one depth together; a directory with nothing to say has an empty one.
    """
    kept = repo.included(files, include, exclude)
    dirs = repo.directories(kept, files.select("repo_id").distinct())
    if reasoner is None:
        return repo.flat_index(dirs)
    dirs, contexts = staged(dirs, "dirs"), staged(repo.contexts(kept, texts), "contexts")
    done = below = None
    for depth in range(dirs.agg(F.max("depth")).first()[0] or 0, -1, -1):
        level = dirs.where(F.col("depth") == depth)
        asked = level.select("repo_id", "path").join(contexts, ["repo_id", "path"], "left").withColumn("context", F.coalesce("context", F.lit("")))
        if below is not None:  # the level before has all their children
            asked = repo.with_child_summaries(asked, below)
        said = reasoner.summary(asked.where("context <> ''"), "context", "summary").unionByName(asked.where("context = ''").withColumn("summary", F.lit("")))
        below = staged(level.join(said.select("repo_id", "path", "summary"), ["repo_id", "path"]), "summaries")
        done = below if done is None else done.unionByName(below)
    return repo.flat_index(done)


def statistics(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    return repo.statistics(repo.directories(repo.included(files, include, exclude), files.select("repo_id").distinct()))
