"""Views over the supplied tables, registered queries and the digest pipeline."""
