"""Search, award history and eligibility as table functions with parameters, for users who ask in SQL.

The functions are SQL over the registered views, so filters reach the files and a search is a top-k as it is in the
DataFrame jobs. A prefix is literal, an absent argument sets no condition, and bounds include their value.

    SELECT * FROM search_tenders('45', max_budget => 1e6)
    SELECT * FROM past_awards('45', most => 5)
    SELECT * FROM company_eligibility(array('45'), 3e5, array('ISO 9001'), 9.5e5) WHERE verdict <> 'not_eligible'
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tenderloom.functions.text import WHITE_SPACE
from tenderloom.schemas import EXTRACTIONS, NOTICES, TENDERS

_SUMMARY = """entry_id AS tender_id, expediente, title, budget AS budget_eur, cpv_primary AS cpv,
           date_format(deadline, 'yyyy-MM-dd') AS deadline, CAST(size(documents) AS BIGINT) AS documents"""
_SUMMARY_TYPES = (
    "tender_id STRING, expediente STRING, title STRING, budget_eur DOUBLE, cpv STRING, deadline STRING, documents BIGINT"
)
# Names in the form of `functions.text.fold_case`: stripped and case-folded, the dotless i left out of the middle step.
_LOWERED = f"translate(lower(btrim(name, '{WHITE_SPACE}')), '\u0131', '\ue000')"
_FOLDED = f"transform({{names}}, name -> lower(translate(upper({_LOWERED}), '\ue000', '\u0131')))"

FUNCTIONS = {
    "search_tenders": f"""
        (cpv_prefix STRING DEFAULT NULL, max_budget DOUBLE DEFAULT NULL, min_budget DOUBLE DEFAULT NULL, most INT DEFAULT 20)
        RETURNS TABLE ({_SUMMARY_TYPES})
        RETURN SELECT * EXCEPT (place) FROM (
            SELECT {_SUMMARY}, row_number() OVER (ORDER BY budget DESC NULLS LAST, entry_id) AS place
            FROM tenders
            WHERE (coalesce(cpv_prefix, '') = '' OR startswith(cpv_primary, cpv_prefix))
                AND (max_budget IS NULL OR budget <= max_budget) AND (min_budget IS NULL OR budget >= min_budget))
        WHERE place <= most""",
    "tender_details": f"""
        (wanted STRING)
        RETURNS TABLE ({_SUMMARY_TYPES}, document_links ARRAY<STRUCT<kind: STRING, name: STRING, uri: STRING>>)
        RETURN SELECT {_SUMMARY}, documents AS document_links FROM tenders WHERE entry_id = wanted""",
    "past_awards": """
        (cpv_prefix STRING, most INT DEFAULT 10)
        RETURNS TABLE (notice STRING, title STRING, award_value_eur DOUBLE, winners ARRAY<STRING>, outcome STRING)
        RETURN SELECT * EXCEPT (place) FROM (
            SELECT publication_number AS notice, title, result_value AS award_value_eur,
                coalesce(winner_names, CAST(array() AS ARRAY<STRING>)) AS winners, award_outcome AS outcome,
                row_number() OVER (ORDER BY result_value DESC NULLS LAST, publication_number) AS place
            FROM notices WHERE kind = 'award' AND startswith(cpv_primary, cpv_prefix))
        WHERE place <= most""",
    "award_outcome_counts": """
        (cpv_prefix STRING) RETURNS TABLE (outcome STRING, n BIGINT)
        RETURN SELECT award_outcome, count(*) FROM notices
        WHERE kind = 'award' AND award_outcome IS NOT NULL AND startswith(cpv_primary, cpv_prefix)
        GROUP BY award_outcome""",
    "company_eligibility": f"""
        (cpv_prefixes ARRAY<STRING> DEFAULT NULL, annual_turnover DOUBLE DEFAULT NULL,
         certifications ARRAY<STRING> DEFAULT NULL, max_contract_value DOUBLE DEFAULT NULL)
        RETURNS TABLE (tender_id STRING, title STRING, verdict STRING, scope STRING, solvency STRING,
                       certification STRING, capacity STRING)
        RETURN SELECT tender_id, title,
            CASE WHEN 'fail' IN (scope, solvency, certification, capacity) THEN 'not_eligible'
                 WHEN 'unverified' IN (scope, solvency, certification, capacity) THEN 'unknown' ELSE 'eligible' END,
            scope, solvency, certification, capacity
        FROM (
            SELECT t.entry_id AS tender_id, t.title,
                CASE WHEN coalesce(size(cpv_prefixes), 0) <= 0 THEN 'not_applicable'
                     WHEN coalesce(t.cpv_primary, '') = '' THEN 'unverified'
                     WHEN exists(cpv_prefixes, prefix -> startswith(t.cpv_primary, prefix)) THEN 'pass'
                     ELSE 'fail' END AS scope,
                CASE WHEN annual_turnover IS NULL THEN 'not_applicable'
                     WHEN r.solvency_turnover_required IS NULL THEN 'unverified'
                     WHEN annual_turnover >= r.solvency_turnover_required THEN 'pass' ELSE 'fail' END AS solvency,
                CASE WHEN coalesce(size(r.required_certifications), 0) <= 0 THEN 'unverified'
                     WHEN forall({_FOLDED.format(names="r.required_certifications")}, asked -> coalesce(array_contains(
                              {_FOLDED.format(names="coalesce(certifications, CAST(array() AS ARRAY<STRING>))")},
                              asked), true)) THEN 'pass' ELSE 'fail' END AS certification,
                CASE WHEN max_contract_value IS NULL THEN 'not_applicable' WHEN t.budget IS NULL THEN 'unverified'
                     WHEN t.budget <= max_contract_value THEN 'pass' ELSE 'fail' END AS capacity
            FROM tenders t LEFT JOIN requirements r ON r.tender_id = t.entry_id)""",
}


def register_functions(spark: SparkSession) -> None:
    """Temporary functions over the views `tenders`, `notices` and `requirements`, as they are now; a view that is not
    there yet becomes an empty one."""
    for name, schema in (("tenders", TENDERS), ("notices", NOTICES), ("requirements", EXTRACTIONS)):
        if not spark.catalog.tableExists(name):
            spark.createDataFrame([], schema).createOrReplaceTempView(name)
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} {body}")
