"""partita: score analytics and annotation analytics on Spark."""
