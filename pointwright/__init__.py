"""pointwright: point-cloud analytics and text-corpus operators as Spark plans."""
