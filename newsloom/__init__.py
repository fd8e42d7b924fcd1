"""newsloom: a PySpark-native engine for acquiring, cleaning and reporting news content."""
