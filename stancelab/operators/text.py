"""Text operators: pattern scans (P22), labelling prompts.

Scans evaluate every pattern as its own column in ONE projection over the text
table and unpivot with a literal-array explode: the pattern list is a fixed
parameter, so there is no documents x patterns join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_limit
from .ordering import first_k

# The forbidden-text patterns of the study (a drive path, an API-key
# shape, a home-directory path), written in the syntax both Java regex and RE2 accept.
STUDY_PATTERNS: tuple[tuple[str, str], ...] = (
    ("drive_path", "(?i)Z:/"),
    ("api_key", "sk-[A-Za-z0-9]{20,}"),
    ("home_path", "/home/[^\\s'\"]+"),
)
# Additional shapes that do occur in web-like text; patterns are a parameter.
EXTRA_PATTERNS: tuple[tuple[str, str], ...] = (
    ("token_assignment", "token = \"[0-9a-f]+\""),
    ("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"),
)
# A literal every match of a pattern contains (keyed by the pattern itself): texts
# without it skip the regular expression.
PATTERN_HINTS = {rx: hint for (_, rx), hint in zip(STUDY_PATTERNS + EXTRA_PATTERNS,
                                                   (":/", "sk-", "/home/", "token = ", "@"))}

# Fixed value: the cluster-labelling prompt template.
LABEL_PROMPT_TEMPLATE = (
    "You are labeling clusters of short political justifications from a replication archive.\n"
    "Read the sampled justifications and provide a short substantive label for the common theme.\n"
    "\n"
    "Cluster {cluster}\n"
    "Examples:\n"
    "{examples}\n"
)


def pattern_hits(df: DataFrame, text: str, id_cols: Sequence[str],
                 patterns: Sequence[tuple[str, str]] = STUDY_PATTERNS + EXTRA_PATTERNS) -> DataFrame:
    """(ids..., pattern, hits) for every text with at least one match of a pattern."""
    t = F.coalesce(F.col(text), F.lit(""))

    def count(name: str, rx: str) -> Column:
        hits = F.regexp_count(t, F.lit(rx))
        hint = PATTERN_HINTS.get(rx)
        return F.when(F.instr(t, hint) > 0, hits).otherwise(F.lit(0)) if hint else hits

    cells = F.array(*[F.struct(F.lit(name).alias("pattern"), count(name, rx).alias("hits"))
                      for name, rx in patterns])
    return (df.select(*id_cols, F.explode(cells).alias("h"))
            .where(F.col("h.hits") > 0)
            .select(*id_cols, "h.pattern", F.col("h.hits").cast("long").alias("hits")))


def pattern_summary(hits: DataFrame, patterns: Sequence[tuple[str, str]] = STUDY_PATTERNS + EXTRA_PATTERNS
                    ) -> DataFrame:
    """Per pattern: texts with a hit and total hits; patterns without hits report 0."""
    agg = hits.groupBy("pattern").agg(F.count(F.lit(1)).cast("long").alias("n_texts"),
                                      F.sum("hits").cast("long").alias("n_hits"))
    names = F.array(*[F.lit(n) for n, _ in patterns])
    all_p = hits.sparkSession.range(1).select(F.explode(names).alias("pattern"))
    return (all_p.join(agg, "pattern", "left")
            .select("pattern", F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts"),
                    F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits")))


def labelling_prompts(assignments: DataFrame, cluster: str, text: str, order: Sequence[str],
                      k: int = 20, template: str = LABEL_PROMPT_TEMPLATE) -> DataFrame:
    """One prompt per cluster with its first ``k`` non-null texts as ``- text`` lines.

    The head of each cluster is ranked on a narrow (cluster, order) projection by
    :func:`first_k` (no whole-group window), so texts are not shuffled to be
    ranked; only the winners' texts are then fetched.  That lookup broadcasts the
    winners when clusters x k rows is under the broadcast threshold (one count of
    distinct clusters) and is a shuffled join otherwise.  The per-cluster collect
    holds at most k rows.  ``order`` must be a total order within a cluster.
    """
    order = list(order)
    rows = assignments.where(F.col(text).isNotNull())
    head = first_k(rows.select(cluster, *order), k, order, [cluster], name="_pos")
    n_clusters = rows.select(cluster).distinct().count()
    bounded = 0 < n_clusters * k * 256 <= broadcast_limit(rows.sparkSession)   # <= 256 bytes a row
    picked = rows.select(cluster, *order, text).join(F.broadcast(head) if bounded else head, [cluster, *order])
    ex = picked.groupBy(cluster).agg(F.sort_array(F.collect_list(F.struct("_pos", text))).alias("_ex"))
    examples = F.array_join(F.transform("_ex", lambda s: F.concat(F.lit("- "), s.getField(text))), "\n")
    prompt = F.replace(F.replace(F.lit(template), F.lit("{cluster}"), F.col(cluster).cast("string")),
                       F.lit("{examples}"), examples)
    return ex.select(cluster, prompt.alias("labeling_prompt"))
