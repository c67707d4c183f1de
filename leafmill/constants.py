"""Fixed values of the commitment format. They enter hashed bytes or are reason codes, so they must be exactly these."""

from __future__ import annotations

# Identifiers of the format.
CANON = "ROAX-CANON/1"
HASH_ALG = "SHA-256"
TYPE_MAP_DOMAIN = b"ROAX-TYPE-MAP/1\0"
ORDERINGS = {"path": "", "hash": "/hash"}

# Reserved leaves. Each path is one key, dots included.
RESERVED_PREFIX = "roax."
RECORD_TYPE = "roax.recordType"
SCHEMA_VERSION = "roax.schemaVersion"
TYPE_MAP_ID = "roax.typeMap.id"
RECORD_ID = "roax.recordId"
ISSUER_ID = "roax.issuer.id"
ISSUER_KEY_ID = "roax.issuer.keyId"
ORDERING = "roax.ordering"

# Type tags.
NULL, BOOL, STRING, INTEGER, DECIMAL, BYTES, EMPTY_ARRAY, EMPTY_OBJECT, BLOB_REF = range(9)

#: The JSON kinds a tag is carried by in a record.
TAG_KINDS = {NULL: "null", BOOL: "boolean", STRING: "string", INTEGER: "number", DECIMAL: "number", BYTES: "string", EMPTY_ARRAY: "array", EMPTY_OBJECT: "object"}

# Bounds.
MAX_DIGITS = 1024
MAX_INDEX = 2**32 - 1
MAX_DEPTH = 512
SALT_BYTES = 16

#: Paths of each record type that every disclosed copy must show, as keys.
PROFILE_FLOORS = {
    "hl7.fhir.bundle": [["resourceType"]],
    "sg.gov.moh.pdt-healthcert": [["version"], ["type"], ["validFrom"]],
    "sg.gov.moh.recovery-healthcert": [["version"], ["type"], ["validFrom"], ["validUntil"]],
    "sg.gov.moh.vaccination-healthcert": [["validFrom"], ["notarisationMetadata", "reference"]],
}

#: The type of a path column.
PATH_TYPE = "array<struct<key:string,index:bigint>>"
