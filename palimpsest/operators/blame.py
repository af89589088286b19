"""What each line of a section goes back to: its identity through the revisions, by the alignment of each text with the next."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .apply import common_lines
from .batches import flat_mapped
from .lineage import spread

BLAME = "line_number int, content string, created_in long, changed_in long, moved_in long"


def blamed(history: Sequence[tuple[int, str | None]]) -> list[tuple[str, int, int, int | None]]:
    """(line, revision that made it, revision that gave it its words, revision that last moved it) of the last text of a history, oldest first.

    Lines that two texts have in common, in order, are the same; so is a line that goes at one place
    and stands at another, which has moved; of the other lines that go and come between the same
    neighbours, the first that comes is the first that went, in new words, and so on. What is left is
    new. A null text has no lines; what comes after it is new.
    """
    now: list[tuple[str, int, int, int | None]] = []
    for revision, text in history:
        lines = (text or "").splitlines()
        old = [x[0] for x in now]
        common = common_lines(old, lines)
        new: list[tuple | None] = [None] * len(lines)
        kept = set()
        for i, j in common:
            new[j] = now[i]
            kept.add(i)
        gone: dict[str, deque[int]] = defaultdict(deque)
        for i in range(len(old)):
            if i not in kept and old[i].strip():
                gone[old[i]].append(i)
        for j, line in enumerate(lines):
            if new[j] is None and gone.get(line):
                i = gone[line].popleft()
                kept.add(i)
                new[j] = (*now[i][:3], revision)
        begin = (0, 0)
        for i, j in [*common, (len(old), len(lines))]:
            went = deque(k for k in range(begin[0], i) if k not in kept)
            for k in range(begin[1], j):
                if new[k] is None:
                    origin = now[went.popleft()] if went else None
                    new[k] = (lines[k], origin[1] if origin else revision, revision, origin[3] if origin else None)
            begin = (i + 1, j + 1)
        now = new
    return now


def blame(states: DataFrame, key: list[str], revision: str = "revision_id", order: str = "sequence_number", text: str = "text_content") -> DataFrame:
    """The lines of each section's newest text with BLAME, from rows of its texts at revisions.

    A section is folded by itself over its own history, which holds a row only where it changed;
    sections are independent, so that revisions need not be played one by one. Rows of equal order
    follow the revision.
    """
    past = F.sort_array(F.collect_list(F.struct(F.col(order).cast("long").alias("o"), F.col(revision).cast("long").alias("r"), F.col(text).alias("t"))))
    rows = states.groupBy(*key).agg(past.alias("_past")).select(*key, F.col("_past.r").alias("_revisions"), F.col("_past.t").alias("_texts"))
    kinds = ", ".join(f"{k} {states.schema[k].dataType.simpleString()}" for k in key)

    def run(*row: object) -> Iterator[tuple]:
        *own, revisions, texts = row
        return ((*own, n, *x) for n, x in enumerate(blamed(list(zip(revisions, texts, strict=True))), 1))

    return flat_mapped(spread(rows), run, f"{kinds}, {BLAME}")


def with_laws(lines: DataFrame, revisions: DataFrame, laws: DataFrame, key: list[str]) -> DataFrame:
    """Lines with the law (law_id and its label) and the day of the revisions that made and that changed them; nulls where a revision is no law's.

    revisions: revision_id, law_id, effective_date; laws: law_id, label.
    """
    named = revisions.join(laws, "law_id", "left").select("revision_id", "law_id", "label", "effective_date")
    out = lines
    for role in ("created", "changed"):
        own = named.select(F.col("revision_id").alias(f"_{role}"), F.col("law_id").alias(f"{role}_law_id"), F.col("label").alias(f"{role}_law"), F.col("effective_date").alias(f"{role}_on"))
        out = out.join(own, F.col(f"{role}_in") == F.col(f"_{role}"), "left").drop(f"_{role}")
    return out.select(*key, "line_number", "content", "created_in", "created_law_id", "created_law", "created_on", "changed_in", "changed_law_id", "changed_law", "changed_on", "moved_in")
