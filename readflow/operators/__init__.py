"""DataFrame operators: segmentation, timing, pages, crawl admission, reading activity."""
