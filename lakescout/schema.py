"""Fixed schemas and enumerations of the lake's catalogue."""

from __future__ import annotations

from enum import IntEnum

PROFILE = "nid string, db_name string, path string, source_name string, column_name string, data_type string, total_values bigint, unique_values bigint, entities string, minhash array<bigint>, min_value double, max_value double, avg_value double, median double, iqr double"
TEXT_INDEX = "nid string, db_name string, source_name string, column_name string, text string"
NODES = "nid string, db_name string, source_name string, field_name string, data_type string, cardinality double"
EDGES = "src_nid string, dst_nid string, relation string, score double"
HITS = "nid string, db_name string, source_name string, field_name string, score double"
PROVENANCE = "src_nid string, dst_nid string, op string"
ANNOTATIONS = "id string, author string, class string, text string, source string, target string, relation string, tags array<string>"


class Relation(IntEnum):
    SCHEMA = 0
    SCHEMA_SIM = 1
    CONTENT_SIM = 2
    ENTITY_SIM = 3
    PKFK = 5
    INCLUSION_DEPENDENCY = 6
    MEANS_SAME = 10
    MEANS_DIFF = 11
    SUBCLASS = 12
    SUPERCLASS = 13
    MEMBER = 14
    CONTAINER = 15

    @property
    def is_metadata(self) -> bool:
        return self >= 10


class ViewClass(IntEnum):
    EQUIVALENT = 1
    DIF_CARDINALITY = 2
    DIF_SCHEMA = 3
    DIF_VALUES = 4
