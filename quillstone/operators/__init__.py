"""Part of quillstone: operators."""
