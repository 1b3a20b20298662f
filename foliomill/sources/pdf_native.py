"""Earlier name of the PDF reader's functions."""

from .pdf import count_images, layout_text, parse_pages, pdf_pages, simple_text

__all__ = ["count_images", "layout_text", "parse_pages", "pdf_pages", "simple_text"]
