"""The registry with all built-in converters."""

from __future__ import annotations

from sparkdocs import schemas as S
from sparkdocs.convert import diagram, html, image, media, outline, text
from sparkdocs.convert.registry import ConverterRegistry


def default_registry(with_probes: bool = False, images: image.ImageSources | None = None) -> ConverterRegistry:
    """Structured types (PDF, Office) have no built-in converter; register one to take them in.

    `with_probes`: the rows carry `probe_json`, so media files can be converted. `images`: side tables of
    text extraction; without them an image keeps its name only.
    """
    registry = ConverterRegistry()
    registry.register(S.extensions_of("native"), S.DIRECT, column=text.native_markdown)
    registry.register(S.extensions_of("plain_text"), S.TEXT, column=text.plain_text)
    registry.register(S.extensions_of("code"), S.CODE, column=text.code_block)
    if images:
        registry.register(S.extensions_of("image"), S.IMAGE, frame=image.image_frame(images))
    else:
        registry.register(S.extensions_of("image"), S.IMAGE, column=text.image_title)
    registry.register(S.extensions_of("html"), S.HTML, frame=html.html_frame)
    registry.register(S.extensions_of("xmind"), S.OUTLINE, frame=outline.outline_frame)
    registry.register(S.extensions_of("diagram"), S.DIAGRAM, frame=diagram.diagram_frame)
    if with_probes:
        registry.register(S.extensions_of("video"), S.MEDIA, frame=media.media_frame)
    return registry
