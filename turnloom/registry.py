"""All queries of the library outside the llm subpackage."""

from .functions import asked, dates, documents, routes, text, tokens
from .operators import aggregates, filters, graph, joins, lookups, memory, merging, quality, recurrences, scores, sets, turns, walks, windows
from .plans import bundles, evaluation, evidence, gates, inverted, judging, metrics, retrieval, router, routing, searches
from .streaming import events, folds
from .sql import collect

FLAGSHIP = "x_flagship_lexical_topk"
QUERIES, ORACLE_SQL = collect(retrieval, evaluation, joins, aggregates, windows, graph, memory, merging, inverted, documents, bundles, quality, recurrences, events, folds, filters, scores, text, sets, tokens, gates, searches, lookups, metrics, evidence, routing, turns, routes, asked, walks, judging, dates, router)
