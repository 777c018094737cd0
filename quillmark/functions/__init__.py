"""Part of quillmark; see README.md."""
