"""graphloom: a Spark-native engine for ranking over versioned file histories."""
