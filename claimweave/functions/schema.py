"""Row types of the library."""

CLAIM = (
    "entity_id string, ord bigint, field string, raw_value string, normalized_value string, source string, source_type string, extraction_method string, "
    "extraction_position string, confidence double, normalization_status string, normalization_applied array<string>, corroborated_by array<string>, "
    "conflict_with array<string>, extraction_notes string, canonical_name string, match_type string, fuzzy_score double"
)
ROLE = "struct<company:string,title:string,start:string,end:string,summary:string,concurrent:boolean,sources:array<string>,confidence:double>"
EDUCATION = "struct<institution:string,degree:string,field:string,end_year:int,sources:array<string>,confidence:double>"
PROVENANCE = "struct<field:string,winning_value:string,winning_source:string,winning_method:string,winning_confidence:double,resolution_strategy:string,conflict_detected:boolean,transformation_applied:array<string>,all_claims:string>"
SKILL = "struct<name:string,confidence:double,sources:array<string>>"
CANONICAL = (
    "candidate_id string, full_name string, emails array<string>, phones array<string>, location struct<city:string,region:string,country:string>, "
    "links struct<linkedin:string,github:string,portfolio:array<string>,other:array<string>>, headline string, years_experience double, "
    f"skills array<{SKILL}>, experience array<{ROLE}>, education array<{EDUCATION}>, provenance array<{PROVENANCE}>, overall_confidence double, "
    "timestamp string, source_files array<string>, warnings array<string>"
)


def canonical_schema():
    """The profile's type as a StructType."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(CANONICAL)
