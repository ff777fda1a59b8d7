"""Hand-written pages: (html, sentences that must be there, sentences that must not)."""

PAGES = [
    (  # a blog post with links in its prose, no article element
        '<div class="post"><p>First para of the story goes here, with text.</p><p>See the <a href="/x">full annual report on river health</a> for details.</p><p>Last para.</p></div>',
        ["First para of the story goes here, with text.", "See the full annual report on river health for details.", "Last para."], [],
    ),
    (  # the same beside a small table and a menu
        '<body><ul class="menu"><li><a href="/">Home</a><li><a href="/b">Blog</a></ul><div class="post"><p>First para of the story goes here, with text.</p><p>See the <a href="/x">full annual report on river health</a> for details.</p>'
        "<table><tr><td>Year<td>Catch</tr><tr><td>1998<td>12 tons</tr></table><p>Last para.</p></div></body>",
        ["First para of the story goes here, with text.", "See the full annual report on river health for details.", "1998 12 tons", "Last para."], ["Home", "Blog"],
    ),
    (  # a news page with generated class names
        '<html><head><title>T</title></head><body><div class="css-1k2j3"><div class="css-99x"><a href="/">Daily</a> <a href="/w">World</a> <a href="/s">Sport</a> <a href="/a">Arts</a></div>'
        '<div class="css-7fgh"><h1>Ferry returns to the northern islands</h1><p>The ferry between the two northern islands sails again from Monday, the harbour office said.</p>'
        "<p>It had been laid up since a storm in March broke the landing stage.</p><p>Tickets cost as much as before, and bicycles travel free.</p></div>"
        '<div class="css-0ab"><a href="/p">Privacy</a> | <a href="/t">Terms</a> | <a href="/c">Contact us</a></div></div></body></html>',
        ["Ferry returns to the northern islands", "The ferry between the two northern islands sails again from Monday, the harbour office said.", "It had been laid up since a storm in March broke the landing stage.", "bicycles travel free."], ["Sport", "Terms"],
    ),
    (  # an encyclopedia page dense with links, a sidebar and a list
        '<body><div id="header"><a href="/">Encyclopedia</a><form><input name=q><button>Search</button></form></div><div id="sidebar"><h3>Tools</h3><ul><li><a href="/r">Recent changes</a></li><li><a href="/u">Upload file</a></li></ul></div>'
        '<div id="content"><h1>Barley</h1><p><b>Barley</b>, a member of the <a href="/g">grass family</a>, is a major <a href="/c">cereal grain</a> grown in <a href="/t">temperate climates</a> around the world.</p>'
        '<p>It was one of the first cultivated grains, particularly in <a href="/e">Eurasia</a> as early as 10,000 years ago.</p><ul><li>Two-row barley is used for malt.</li><li>Six-row barley is used for <a href="/f">animal feed</a>.</li></ul></div>'
        '<div id="footer"><p>Text is available under a free licence; terms may apply.</p></div></body>',
        ["Barley, a member of the grass family, is a major cereal grain grown in temperate climates around the world.", "as early as 10,000 years ago.", "Two-row barley is used for malt.", "Six-row barley is used for animal feed."], ["Recent changes", "Search", "free licence"],
    ),
    (  # cookie notice, newsletter form, reader comments
        '<body><div class="cookie-banner"><p>We use cookies to improve your visit. By staying you agree to our policy.</p><button>Accept</button></div><main><h1>How to mend a kettle</h1><p>Unplug the kettle first and let it cool.</p><p>Then loosen the three screws under its base.</p></main>'
        '<form class="newsletter"><p>Get our letter every Friday.</p><input name=e></form><section id="comments"><h3>2 comments</h3><div class="comment"><p>Thanks, this helped me a lot with my old kettle.</p></div><div class="comment"><p>Mine had four screws, be careful.</p></div></section></body>',
        ["How to mend a kettle", "Unplug the kettle first and let it cool.", "Then loosen the three screws under its base."], ["cookies", "Friday", "helped me a lot", "four screws"],
    ),
    (  # a very short article
        '<body><nav><a href="/">Start</a> <a href="/n">News</a></nav><article><p>The bridge is open again.</p></article><footer>Town council, all rights reserved.</footer></body>',
        ["The bridge is open again."], ["Start", "all rights reserved"],
    ),
    (  # text straight in a body, line breaks for paragraphs
        "<body>Once there was a miller who had three sons.<br><br>The youngest of them went out into the world.<br>He came back with a cat.</body>",
        ["Once there was a miller who had three sons.", "The youngest of them went out into the world.", "He came back with a cat."], [],
    ),
    (  # table layout of an old site
        '<body><table width=100%><tr><td class="nav"><a href=a>Home</a><br><a href=b>Pictures</a><br><a href=c>Guestbook</a></td><td><h2>Our trip to the lakes</h2><p>We left early and had rain until noon, so we stayed in the car.</p><p>In the afternoon the sun came out, and we rowed across the lake.</p></td></tr></table></body>',
        ["Our trip to the lakes", "We left early and had rain until noon, so we stayed in the car.", "we rowed across the lake."], ["Guestbook"],
    ),
    (  # an article of several linked paragraphs and a quotation, related links after it
        '<article class="story"><header><h1>Orchard prices fall</h1></header><p>Growers in the valley expect <a href="/1">the lowest price for cider apples in nine years</a>, a survey shows.</p>'
        '<p><a href="/2">Last autumn</a> was mild, and <a href="/3">yields rose by a fifth</a>.</p><blockquote><p>"We will press what we cannot sell," said one grower.</p></blockquote><div class="related"><h4>Related</h4><ul><li><a href="/4">Frost warning</a></li><li><a href="/5">New cider press</a></li></ul></div></article>',
        ["Orchard prices fall", "Growers in the valley expect the lowest price for cider apples in nine years, a survey shows.", "Last autumn was mild, and yields rose by a fifth.", '"We will press what we cannot sell," said one grower.'], ["Frost warning"],
    ),
    (  # documentation with code
        '<body><div class="toc"><ul><li><a href="#a">Install</a></li><li><a href="#b">Use</a></li></ul></div><div role="main"><h1>Using the tool</h1><p>Call <code>run</code> with a <a href="/p">path</a>:</p><pre>run --all here</pre><p>It prints one line per file.</p></div></body>',
        ["Using the tool", "Call run with a path:", "run --all here", "It prints one line per file."], [],
    ),
]
