"""Views over the driver's tables, registered queries and their SQL."""
