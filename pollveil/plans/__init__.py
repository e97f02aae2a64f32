"""The data model, storage helpers, and the registered queries with their SQL."""
