"""quillmark: stylometry and text analytics as PySpark DataFrame plans."""
