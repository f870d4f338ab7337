"""quillmap: documentation-site audits expressed as Spark DataFrame plans."""
