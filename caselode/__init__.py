"""caselode: document-casework analytics as Spark DataFrame transformations."""
