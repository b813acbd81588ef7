"""Keeps an operator's own helper columns apart from columns of the input that have the same names."""

from __future__ import annotations

from functools import wraps

USED = ("doc_id", "text", "lang", "source", "n_chars")


def any_names(operator):
    """The operator sees the columns of documents under their names and all others under names that no operator uses;
    its result has the given names again, with the values they had."""

    @wraps(operator)
    def run(docs, *args, **kwargs):
        others = {c: f"input_column_{i}" for i, c in enumerate(docs.columns) if c not in USED}
        out = operator(docs.withColumnsRenamed(others), *args, **kwargs)
        return out.withColumnsRenamed({v: k for k, v in others.items()})

    return run
