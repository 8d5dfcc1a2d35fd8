"""Evidence analytics over gridded scenes, declared as Spark DataFrame plans."""
