"""tidewright: flood-risk, routing and corpus analytics written as Spark plans."""
