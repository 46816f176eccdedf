"""The queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from tidewire.llm import cooccurrence, encoding, frequency, leakage, near_duplicates, neighbours, proportions, spans, split_overlap, sql, subjects

QUERIES = {
    "p1_found": proportions.p1_found,
    "p1_report": proportions.p1_report,
    "p1_sample": proportions.p1_sample,
    "p2_found": neighbours.p2_found,
    "p2_neighbours": neighbours.p2_neighbours,
    "p2_accuracy": neighbours.p2_accuracy,
    "p3_found": near_duplicates.p3_found,
    "p3_groups": near_duplicates.p3_groups,
    "p4_found": subjects.p4_found,
    "p4_makeup": subjects.p4_makeup,
    "p5_found": split_overlap.p5_found,
    "p5_report": split_overlap.p5_report,
    "p6_found": frequency.p6_found,
    "p6_counts": frequency.p6_counts,
    "p7_found": cooccurrence.p7_found,
    "p7_pairs": cooccurrence.p7_pairs,
    "p8_ids": encoding.p8_ids,
    "p9_found": leakage.p9_found,
    "p9_items": leakage.p9_items,
    "p10_found": spans.p10_found,
    "p10_share": spans.p10_share,
}

ORACLES: dict[str, str] = proportions.ORACLES | frequency.ORACLES | cooccurrence.ORACLES | sql.ORACLES
