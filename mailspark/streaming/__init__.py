"""The same operators on incremental input, through Structured Streaming."""
