"""From records to stored tables in one step."""

from __future__ import annotations

from pyspark.sql import DataFrame

from canopy.operators.rules import RuleSet
from canopy.session import scratch_path
from canopy.sources.store import Store


def analyze(records: DataFrame, rules: RuleSet, store: Store, commit: str | None = None) -> int | None:
    """Apply all rules to the records in one scan and store every target table.

    With a ``commit`` its tagged tables are replaced under a new tag, which is returned; the
    rules store a null there. Tables without a tag are added to, known keys being kept.
    """
    tables = rules.write(records, scratch_path(records.sparkSession, "analyze"))
    tagged = {n: t.drop("tag") for n, t in tables.items() if "tag" in store.tables[n].columns}
    if tagged and commit is None:
        raise ValueError(f"{', '.join(sorted(tagged))} need a commit")
    for name, rows in tables.items():
        if name not in tagged:
            store.append(name, rows)
    return store.load(commit, tagged) if commit is not None else None
