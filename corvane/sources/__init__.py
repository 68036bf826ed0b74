"""Files, payloads of web sources, and the snapshot store."""
