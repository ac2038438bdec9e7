"""Finding, choosing and reading the files of an export."""
