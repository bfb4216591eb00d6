"""Part of quillstone: streaming."""
