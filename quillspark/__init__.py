"""quillspark: a Spark-native analytics engine for folders of linked notes."""
