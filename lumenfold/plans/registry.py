"""All queries and their SQL."""

from __future__ import annotations

from lumenfold.plans import corpus, decisions, flows, incremental, lifecycle, listings, moves, relational, textsearch, versions

QUERIES = {**relational.QUERIES, **corpus.QUERIES, **incremental.QUERIES, **listings.QUERIES, **lifecycle.QUERIES, **versions.QUERIES, **textsearch.QUERIES, **flows.QUERIES, **decisions.QUERIES, **moves.QUERIES}
SQL = {**relational.SQL, **corpus.SQL, **incremental.SQL, **listings.SQL, **lifecycle.SQL, **versions.SQL, **textsearch.SQL, **flows.SQL, **decisions.SQL, **moves.SQL}
