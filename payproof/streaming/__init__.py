"""The recurring folder check as a Structured Streaming job."""
