"""Views, queries and their SQL, and the registry."""
