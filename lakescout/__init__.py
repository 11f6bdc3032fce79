"""lakescout: data discovery and view synthesis as Spark DataFrame plans."""
