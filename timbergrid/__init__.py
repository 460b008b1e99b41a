"""timbergrid: landscape and forest-planning analytics as Spark DataFrame plans."""
