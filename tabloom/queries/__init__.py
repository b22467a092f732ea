"""The registered queries: a callable of (spark, table folder) each, with equivalent SQL where there is one."""

from tabloom.queries import expressions, frames, learning, profiles, texts

REGISTRY = {**profiles.QUERIES, **expressions.QUERIES, **frames.QUERIES, **learning.QUERIES, **texts.QUERIES}
