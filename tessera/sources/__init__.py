"""Reading and writing project documents, reports and proposed rooms."""
