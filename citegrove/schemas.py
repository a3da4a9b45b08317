"""Schemas of the records that sources give and sinks take."""

from __future__ import annotations

PAPER = (
    "title string, abstract string, authors array<string>, year int, venue string, citations bigint, url string, pdf_url string, doi string, "
    "arxiv_id string, fields_of_study array<string>, topic_ids array<string>, sources array<string>, queries array<string>, buckets array<string>, "
    "tags map<string,array<string>>, semantic_score double"
)
CLAIM = "type string, format_version string, problem_version string, domain string, problem_id string, claim string, artifacts array<string>"
REFERENCE = "type string, format_version string, problem_id string, claim string, experiments array<string>, roles array<string>"
ARM = "model string, condition string, repeat int, evidence_chars int, experiments array<string>, n_returned int, error string"
COVERAGE = "ref_index int, status string, covered_by array<int>, adequacy string, rationale string, reasoning_chain array<string>"
JUDGMENT = f"problem_id string, arm string, runs array<struct<reference_coverage:array<struct<{COVERAGE.replace(' ', ':').replace(',:', ',')}>>,decision_sufficiency:string,missing:array<string>>>"
TRACE = "type string, step int, ts double, payload string, validation_error string"
#: Columns of a paper with their types, in order.
PAPER_COLUMNS = [tuple(c.strip().split(" ", 1)) for c in PAPER.replace("map<string,array<string>>", "map<string;array<string>>").split(",")]
PAPER_COLUMNS = [(n, t.replace(";", ",")) for n, t in PAPER_COLUMNS]
