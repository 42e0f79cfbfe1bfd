"""proselens: prose analytics as Spark plans."""
