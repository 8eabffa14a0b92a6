"""The queries of the training-data problems, and SQL where it can say the same."""

from __future__ import annotations

from . import chunk_split, credentials, invalid_source, mixing, near_dup, neighbours, not_handwritten, packing, stuffing

_ALL = [
    chunk_split.p1_found,
    chunk_split.p1_pieces,
    near_dup.p2_found,
    near_dup.p2_groups,
    invalid_source.p4_found,
    invalid_source.p4_files,
    invalid_source.p4_rates,
    not_handwritten.p5_found,
    not_handwritten.p5_files,
    credentials.p6_found,
    credentials.p6_redacted,
    neighbours.p7_found,
    neighbours.p7_graph,
    packing.p8_containers,
    packing.p8_utilisation,
    packing.p8_checks,
    mixing.p9_mix,
    mixing.p9_shares,
    mixing.p9_checks,
    mixing.p9_temperature,
    stuffing.p10_found,
    stuffing.p10_scores,
]
QUERIES = {f.__name__: f for f in _ALL}
SQL = chunk_split.SQL | near_dup.SQL | neighbours.SQL | packing.SQL | mixing.SQL
