"""SQL for the queries that SQL can express."""

ORACLES = {
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
