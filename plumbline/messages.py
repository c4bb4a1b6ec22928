"""What users read: the texts of verdicts, notes and reasons, in one place."""

# Texts that users of rule sets search for in reports, error columns and skip columns.
RATE_BELOW = "{name} {rate:.2f}% below threshold {threshold:.2f}%"
RATE_OF = "{check} pass rate"
RATE_NAMES = {"completeness": "Completeness", "uniqueness": "Uniqueness"}
VALUE_DIFFERS = "{check}: expected {want} but got {got}"
SCHEMA_DIFFERS = "validate_schema: schema does not match contract ({issues} issues)"
SKIPPED = "Skipped: {reason}"
ERROR = "Error: {why}"
STREAM_NOTE = "pass rate is not computable in streaming"
RECORDS_TABLE = "TABLE-level rules are not supported in streaming"
CONTRACT_TYPE = "Expected {want}, got {got} ({raw})"
CONTRACT_UNKNOWN = "Unknown expected type '{type}'. Valid: {known}"
CONTRACT_UNMAPPED = "Spark type '{raw}' has no canonical mapping"
CONTRACT_ELEMENT = "Array element type mismatch: expected {want}, got {got}"
CONTRACT_NO_COMMENT = "Missing required column comment"
CONTRACT_COMMENT = "Comment mismatch. Expected: '{want}'"
CONTRACT_NULLS = "Schema violation: contract requires NOT NULL but column allows nulls"
